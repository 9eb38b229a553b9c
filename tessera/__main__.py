"""``python -m tessera encode|decode|info [--generation N] [--compression gzip|zstd] [IN [OUT]]``: documents on the command line.

``encode`` makes a document of JSON text, ``decode`` JSON text of a document or of the first value of a stream, ``info`` tells
what a file is.  Files default to standard input and output.
"""

from __future__ import annotations

import argparse
import json
import sys

from tessera.sources import frames, wire


def _described(data: bytes) -> dict:
    """Kind, bytes, dictionary, hints and shape of a binary."""
    if data[:4] == frames.FRAME_MAGIC:
        held = list(frames.split_frames(data))
        return {"kind": "frames", "bytes": len(data), "frames": len(held), "types": sorted({f["type_id"] for f in held})}
    if data[:4] == frames.EVENT_MAGIC:
        return {"kind": "events", "bytes": len(data), "events": sum(1 for _ in frames.split_events(data))}
    value = wire.decode(data)
    kind = "gen2" if data[:3] == wire.MAGIC else "gen1"
    hints = [vars(h) | {"total_bytes": h.total_bytes()} for h in wire.hints_of(data)] if kind == "gen2" else []
    fields = wire.fields_of(data) if kind == "gen2" else []
    return {"kind": kind, "bytes": len(data), "fields": fields, "hints": hints, "shape": wire.shape_of(value), "fingerprint": f"{frames.fingerprint(value):016x}"}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("command", choices=("encode", "decode", "info"))
    parser.add_argument("files", nargs="*", metavar="FILE")
    parser.add_argument("--generation", type=int, choices=(1, 2), default=2)
    parser.add_argument("--compression", choices=("gzip", "zstd"))
    parser.add_argument("--indent", type=int)
    given = parser.parse_args(args)
    if len(given.files) > 2:
        parser.error("one file to read and one to write")
    if given.files:
        with open(given.files[0], "rb") as held:
            data = held.read()
    else:
        data = sys.stdin.buffer.read()
    try:
        if given.command == "encode":
            out = wire.encode(wire.from_json(data.decode()), given.generation, compression=given.compression)
        elif given.command == "decode":
            out = (json.dumps(wire.jsonable(wire.decode(data)), indent=given.indent, ensure_ascii=False) + "\n").encode()
        else:
            out = (json.dumps(_described(data), indent=given.indent) + "\n").encode()
    except ValueError as e:
        print(f"tessera: {e}", file=sys.stderr)
        return 1
    if len(given.files) == 2:
        with open(given.files[1], "wb") as target:
            target.write(out)
    else:
        sys.stdout.buffer.write(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
