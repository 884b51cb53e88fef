"""A small interactive shell: queries end with `;`, commands start with a dot. python -m orrery.shell [GRAPH_FOLDER]"""

from __future__ import annotations

import sys
from collections.abc import Callable

from orrery.api import PropertyGraph, graph

HELP = ".help  .schema  .tables  .stats  .quit; queries end with ;"


def run_line(g: PropertyGraph, line: str) -> str | None:
    """The answer to one command or query; None: quit."""
    line = line.strip()
    if line in (".quit", ".exit"):
        return None
    if line == ".help":
        return HELP
    if line == ".stats":
        return str(g.stats())
    if line in (".tables", ".schema"):
        nodes = [f"(:{':'.join(sorted(t.labels))} {{{', '.join(f'{k}: {v.simpleString()}' for k, v in t.props.items())}}})" for t in g.graph.nodes]
        return "\n".join(nodes + [f"[:{t.type} {{{', '.join(t.props)}}}]" for t in g.graph.edges])
    try:
        r = g.query(line)
        return r.to_json() if r.columns != ["status"] else str(r.stats.as_dict())
    except Exception as e:
        return f"Error: {e}"


def loop(g: PropertyGraph, read: Callable[[], str], write: Callable[[str], None]) -> None:
    held = ""
    while True:
        try:
            line = read()
        except EOFError:
            return
        held = f"{held}\n{line}".strip()
        if held and (held.startswith(".") or held.endswith(";")):
            answer = run_line(g, held)
            if answer is None:
                return
            write(answer)
            held = ""


def main() -> None:
    from pyspark.sql import SparkSession

    if "-v" in sys.argv:
        print("orrery 0.1")
        return
    if "-h" in sys.argv:
        print(__doc__, HELP)
        return
    path = next((a for a in sys.argv[1:] if not a.startswith("-")), None)
    loop(graph(SparkSession.builder.getOrCreate(), path), lambda: input("> "), print)


if __name__ == "__main__":
    main()
