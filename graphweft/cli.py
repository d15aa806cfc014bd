"""Command line: ``spark-submit -m graphweft.cli --csv FILE [--symetric true|false] embedding|validation ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from graphweft.model import Embedding, Graph, HopeParams, SketchParams
from graphweft.operators import sketch, spectral, validation
from graphweft.sources.edge_files import load_graph
from graphweft.sources.store import Output, dump_embedding


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def _methods(p: argparse.ArgumentParser) -> None:
    kinds = p.add_subparsers(dest="kind", required=True)
    s = kinds.add_parser("sketching")
    s.add_argument("--dim", type=int, default=200)
    s.add_argument("--decay", type=float, default=0.2)
    s.add_argument("--nbiter", type=int, default=3)
    hope = kinds.add_parser("hope")
    modes = hope.add_subparsers(dest="mode", required=True)
    precision = modes.add_parser("precision")
    precision.add_argument("--epsil", type=float, required=True)
    precision.add_argument("--maxrank", type=int, required=True)
    precision.add_argument("--blockiter", type=int, required=True)
    rank = modes.add_parser("rank")
    rank.add_argument("--targetrank", type=int, required=True)
    rank.add_argument("--nbiter", type=int, required=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphweft")
    p.add_argument("--csv", required=True, help="edge list with two or three fields a line")
    p.add_argument("--symetric", type=_flag, default=True)
    tasks = p.add_subparsers(dest="task", required=True)
    e = tasks.add_parser("embedding")
    e.add_argument("-o", "--output", default="embedding")
    _methods(e)
    v = tasks.add_parser("validation")
    v.add_argument("--nbpass", type=int, required=True)
    v.add_argument("--skip", type=float, required=True, help="fraction of edges to delete")
    v.add_argument("--centric", action="store_true")
    v.add_argument("--precision", action="store_true", help="precision and recall of the nearest pairs too")
    _methods(v)
    return p


def embed(args: argparse.Namespace, g: Graph) -> Embedding:
    if args.kind == "sketching":
        p = SketchParams(args.dim, args.decay, args.nbiter, args.symetric)
        return sketch.embed(g, p) if args.symetric else sketch.embed_directed(g, p)
    if args.mode == "precision":
        p = HopeParams(epsil=args.epsil, maxrank=args.maxrank, blockiter=args.blockiter)
    else:
        p = HopeParams(rank=args.targetrank, nbiter=args.nbiter)
    return spectral.hope(g, p)[0]


def validate(args: argparse.Namespace, g: Graph) -> dict:
    """Mean and standard error of the figures over the passes; on request the node-centric ones, of every pass and method."""
    rows = validation.validate(g, lambda train: embed(args, train), args.skip, args.nbpass, args.precision, args.centric).collect()
    return {r.figure: {"mean": r["mean"], "error": r.error, "passes": r.passes} for r in sorted(rows, key=lambda r: r.figure)}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphweft").getOrCreate()
    g = load_graph(spark, args.csv, directed=not args.symetric)
    if args.task == "embedding":
        dump_embedding(embed(args, g), Output(args.output))
    else:
        print(json.dumps(validate(args, g)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
