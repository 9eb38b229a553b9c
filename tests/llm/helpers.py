"""Small fixtures with every awkward case, and brute-force versions of the operators."""

import random
import re

SPACE = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def fixture_rows(seed=7):
    """Rows with null and empty texts, ties, repeated rows, copies, near copies, shared passages and a very long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(30)]
    passage = prose(rng, 70)
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(base)]
    n = len(rows)
    rows += [(n, None, "en", "src0", None), (n + 1, "", None, None, 0), (n + 2, " \n\t ", "en", "src1", 4), (n + 3, None, "en", "src9", 0)]
    rows += [(n + 4 + k, base[k % 2], "en", "src0", len(base[k % 2])) for k in range(6)]
    near = base[5].split()
    if len(near) < 120:
        near = (base[5] + " " + prose(rng, 130)).split()
    rows.append((n + 10, " ".join(near), "en", "src2", 0))
    changed = list(near)
    changed[20] = "zzz"
    rows.append((n + 11, " ".join(changed), "en", "src2", 0))
    rows.append((n + 12, "  ".join(near), "en", "src2", 0))
    rows += [(n + 13 + k, f"{prose(rng, 30)} {passage} {prose(rng, 25)}", "fr", "src1", 1) for k in range(4)]
    rows.append((n + 17, prose(rng, 6000), "en", "src0", 1))
    rows += [(None, "no id here at all, one", "en", "src0", 1), (None, "no id here at all, one", "en", "src0", 1), (3, base[3], "en", "src0", len(base[3]))]
    rows.append((n + 18, "Ünïcode ß ÉÉ\x0b" + prose(rng, 60) + " …“quoted” 漢字 x", "de", "src1", 1))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(fixture_rows() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = words(text)
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
