"""The command line: python -m lattice COMMAND."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from lattice import service
from lattice.config import STATE_DIR, load_config, write_default_config


def find_corpus(start: Path) -> Path:
    """The nearest folder from ``start`` upwards that is a corpus."""
    for place in (start.resolve(), *start.resolve().parents):
        if (place / STATE_DIR).is_dir():
            return place
    raise SystemExit(f"no corpus at or above {start}; run init first")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lattice", description="Knowledge graphs from Markdown, on Spark.")
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, *positional: str, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        for x in positional:
            p.add_argument(x)
        p.add_argument("--db", help="the graph's store")
        for flag, default in options.items():
            if default is False:
                p.add_argument(f"--{flag.replace('_', '-')}", action="store_true")
            else:
                p.add_argument(f"--{flag.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        return p

    add("init", "make a corpus of a folder", path=".")
    for name, about in (("build", "ingest, embed, extract, resolve and induce"), ("extract", "ingest and extract"), ("resolve", "merge duplicate entities"), ("induce", "describe the schema")):
        p = add(name, about, **({"force": False} if name == "extract" else {"config": None} if name == "build" else {}))
        p.add_argument("path", nargs="?", default=".")
    add("stats", "counts", json=False)
    add("find", "semantic search", "query", limit=10, json=False)
    add("entities", "list entities", type=None, limit=50, search=None, json=False)
    add("relations", "list relations", predicate=None, subject=None, object=None, limit=50, json=False)
    add("entity", "one entity", "name", type=None, json=False)
    add("neighbors", "a neighbourhood", "name", depth=1, type=None, json=False)
    add("path", "a shortest path", "start", "end", max_depth=5, json=False)
    add("schema", "the current schema", json=False)
    add("export", "write the graph; --rows writes a folder of text files from the executors", format="jsonld", output=None, rows=False)
    add("reset", "empty the graph", hard=False, yes=False)
    add("vacuum", "delete the tables of older versions of the graph")
    add("mcp", "serve tools over standard input and output")
    return out


def _cell(value: object) -> str:
    return "" if value is None else json.dumps(value, ensure_ascii=False) if isinstance(value, (list, dict)) else str(value)


def table(rows: list[dict]) -> str:
    """Rows as a table with a head; a cell is one line of at most 60 characters."""
    names = list(rows[0])
    cells = [[" ".join(_cell(r.get(n)).split()) for n in names] for r in rows]
    cells = [[c if len(c) <= 60 else c[:59] + "…" for c in row] for row in [names, *cells]]
    widths = [max(len(row[i]) for row in cells) for i in range(len(names))]
    lines = [" | ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])


def _show(value: object, as_json: bool) -> None:
    """JSON, or tables: one for a list of rows, for a record its plain values and then a table for each list in it."""
    if as_json or not isinstance(value, (list, dict)):
        print(json.dumps(value, indent=2))
    elif isinstance(value, list):
        print(table(value) if value else "nothing found")
    else:
        lists = {k: v for k, v in value.items() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)}
        for k, v in value.items():
            if k not in lists:
                print(f"{k}: {_cell(v)}")
        for k, v in lists.items():
            print(f"\n{k}\n{table(v)}")


def main(argv: list[str] | None = None, spark=None) -> int:
    from lattice.plans import build
    from lattice.session import session
    from lattice.sources.models import get_embedder, get_model
    from lattice.sources.store import Store, build_lock

    a = parser().parse_args(argv)
    writes = a.command in ("build", "extract", "resolve", "induce")
    if a.command == "init":
        root = Path(a.path).resolve()
        state = root / STATE_DIR
        if state.exists():
            print(f"already a corpus: {root}")
            return 0
        (state / "prompts").mkdir(parents=True)
        write_default_config(state / "config.yaml")
    else:
        root = Path(a.path).resolve() if writes else None if a.db else find_corpus(Path.cwd())
        if writes and not (root / STATE_DIR).is_dir():
            raise SystemExit(f"{root} is no corpus; run init first")
        state = root / STATE_DIR if root else None
    config = load_config(root) if root else load_config(Path.cwd())
    if a.command == "build" and a.config:
        import yaml

        from lattice.config import merged

        config = merged(config, yaml.safe_load(Path(a.config).read_text(encoding="utf-8")))
    store = Store(spark or session(), a.db or str(state / "graph"))
    if a.command == "init":
        store.init()
        print(f"made a corpus of {root}")
        return 0
    if not store.exists():
        raise SystemExit(f"no graph at {store.path}")
    if writes:
        with build_lock(str(state)):
            embedder, model = get_embedder(config), get_model(config, root)
            if a.command == "build":
                _show(build.build(store, root, config, embedder, model), False)
            elif a.command == "extract":
                found = {"ingest": build.ingest(store, str(root), config), "chunks_embedded": build.embed(store, embedder, "chunks"), "extract": build.extract(store, model, a.force, concurrency=config.get("llm", {}).get("concurrency", 4)), "mentions_embedded": build.embed(store, embedder, "mentions")}
                _show(found, False)
            elif a.command == "resolve":
                _show(build.resolve(store, config, model), False)
            else:
                _show(build.induce(store, config, model), False)
        return 0
    if a.command == "reset":
        if not a.yes and input(f"Empty the graph at {store.path}{' and its documents' if a.hard else ''}? [y/N] ").strip().lower() != "y":
            return 1
        store.reset(a.hard)
        return 0
    if a.command == "vacuum":
        print(f"deleted {store.vacuum()} tables")
        return 0
    if a.command == "mcp":
        from lattice.server import serve

        serve(store.read, lambda: get_embedder(config))
        return 0
    g = store.read()
    if a.command == "export":
        if a.format not in service.FORMATS:
            raise SystemExit(f"formats: {', '.join(service.FORMATS)}")
        if a.output and a.rows:
            service.export_rows(g, a.format).write.text(a.output)
        elif a.output:
            service.write_export(g, a.format, Path(a.output))
        else:
            sys.stdout.writelines(service.FORMATS[a.format](g.entities, g.relations))
        return 0
    value: object
    if a.command == "stats":
        value = service.corpus_stats(g)
    elif a.command == "find":
        value = service.find(g, get_embedder(config), a.query, a.limit)
    elif a.command == "entities":
        value = service.entities(g, a.type, a.search, a.limit)
    elif a.command == "relations":
        value = service.relations(g, a.predicate, a.subject, a.object, a.limit)
    elif a.command == "entity":
        value = service.entity(g, a.name, a.type)
        if value is None:
            raise SystemExit(f"no entity {a.name}")
    elif a.command == "neighbors":
        value = service.neighbors(g, a.name, a.depth, a.type)
    elif a.command == "path":
        value = service.path(g, a.start, a.end, a.max_depth)
        if value is None:
            print("no path" if not a.json else "null")
            return 0
    else:
        value = service.schema(g)
        if value is None:
            print("no schema yet" if not a.json else "null")
            return 0
    _show(value, a.json)
    return 0
