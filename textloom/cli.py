"""The command line: python -m textloom.cli SCRIPT ACTION [NAME] [-c CONF]... [-s KEY=VALUE]... [--root FOLDER].

Scripts, actions and names are those of textloom.actions and of the project's own modules below
FOLDER/actions; configurations are looked up below FOLDER/conf.
"""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path

from textloom import actions
from textloom.session import session


def parser(root: Path) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--root", default=str(root), help="project folder (default: the current one)")
    scripts = p.add_subparsers(dest="script", metavar="script", required=True)
    for script, acts in actions.tree(root).items():
        sub = scripts.add_parser(script, help=", ".join(acts)).add_subparsers(dest="action", metavar="action", required=True)
        for act, names in acts.items():
            one = sub.add_parser(act, help=", ".join(names) or None)
            one.add_argument("name", nargs="?", choices=names or None, help="what to run under the action")
            one.add_argument("-c", "--config", action="append", default=[], metavar="CONF", help="configuration files, in order")
            one.add_argument("-s", "--set", action="append", default=[], metavar="KEY=VALUE", help="single values, after all files")
    return p


def _root(argv: list[str]) -> Path:
    p = argparse.ArgumentParser(add_help=False)
    p.add_argument("--root", default=".")
    return Path(p.parse_known_args(argv)[0].root).resolve()


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    root = _root(argv)
    a = parser(root).parse_args(argv)
    extra = list(a.config)
    with tempfile.TemporaryDirectory() as folder:  # on the driver, for the values given by hand
        if a.set:
            def value(v: str):
                try:
                    return json.loads(v)
                except ValueError:
                    return v

            given = Path(folder, "given.yaml")
            given.write_text(json.dumps({k: value(v) for k, _, v in (x.partition("=") for x in a.set)}), encoding="utf-8")
            extra.append(str(given))
        actions.run(root, a.script, a.action, a.name, tuple(extra), session)


if __name__ == "__main__":
    main()
