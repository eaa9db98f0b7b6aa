"""``python -m quillfin QUERY [PATH ...]``: search from the command line."""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from quillfin import __version__
from quillfin import settings as conf
from quillfin.models.embed import Embedder, HashEmbedder
from quillfin.models.topics import OutlineModel
from quillfin.plans.ingest import Models
from quillfin.plans.search import FORMATS, search
from quillfin.session import local_session
from quillfin.sources.index import Index


LOG_LEVELS = ("ALL", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "OFF")


def embedder_of(name: str | None) -> Embedder:
    """The embedder that ``module:name`` says."""
    if name is None:
        return HashEmbedder()
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found if hasattr(found, "dim") and not isinstance(found, type) else found()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillfin", description=__doc__)
    parser.add_argument("query")
    parser.add_argument("paths", nargs="*", default=["."])
    parser.add_argument("--top-k", type=int, default=None)
    parser.add_argument("--format", choices=FORMATS, default="markdown-rich")
    parser.add_argument("--json", dest="format", action="store_const", const="json")
    parser.add_argument("--markdown", dest="format", action="store_const", const="markdown-rich")
    parser.add_argument("--include-page-images", choices=("none", "path", "base64"), default=None)
    parser.add_argument("--model", metavar="MODULE:NAME", default=None, help="embedder to use: a class or function without arguments, or an object")
    parser.add_argument("--log-level", choices=LOG_LEVELS, default="ERROR")
    parser.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    parser.add_argument("--new", action="store_true", help="start an index in the current directory")
    args = parser.parse_args(argv)

    found = conf.find()
    if found is None or args.new:
        if not args.new:
            print("no index or config file found here or above; use --new to start one", file=sys.stderr)
            return 1
        settings = conf.Root(os.getcwd()).settings() or conf.Settings(index_path=os.path.abspath(conf.INDEX_DIR))
    else:
        settings = found[1]
    try:
        embedder = embedder_of(args.model)
    except (ImportError, AttributeError, ValueError) as exc:
        print(f"no embedder at {args.model}: {exc}", file=sys.stderr)
        return 1
    spark = local_session()
    spark.sparkContext.setLogLevel(args.log_level)
    models = Models(embedder, OutlineModel())
    index = Index(spark, settings.index_path, embedder.dim)
    queries = spark.createDataFrame([("q", args.query)], "query_id string, query string")
    paths = [os.path.abspath(p) for p in args.paths]
    answer = search(index, queries, paths, models, settings, args.top_k, image_mode=args.include_page_images)
    print(answer.render(args.format).first()["response"])
    return 0 if answer.status == "complete" else 1


if __name__ == "__main__":
    sys.exit(main())
