"""``python -m loomery.cli list | check | witnesses | summary``: registered queries and witnesses.

Exits 0 if all witnesses hold, 1 if one does not, 2 without a verb.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomery")
    parser.add_argument("verb", nargs="?", choices=["list", "check", "witnesses", "summary"])
    verb = parser.parse_args(argv).verb
    if verb is None:
        parser.print_usage()
        return 2
    if verb == "list":
        from loomery import catalog

        print("\n".join(sorted(catalog.queries())))
        return 0
    from loomery.session import build_session
    from loomery.witness import testify

    found = testify(build_session(master="local[2]")).collect()
    broken = [r for r in found if not r["holds"]]
    if verb == "witnesses":  # each with all its figures, in full
        for name in sorted({r["witness"] for r in found}):
            own = [r for r in found if r["witness"] == name]
            print(f"{name}: {'holds' if all(r['holds'] for r in own) else 'BROKEN'}")
            for r in own:
                print(f"  {r['metric']} = {r['value']!r}")
    if verb == "check":
        for r in found:
            print(f"{'holds ' if r['holds'] else 'BROKEN'} {r['witness']}.{r['metric']} = {r['value']:g}")
    print(f"{len(found)} figures, {len(broken)} broken")
    return int(bool(broken))


if __name__ == "__main__":
    sys.exit(main())
