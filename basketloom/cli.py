"""Command line: ``python -m basketloom run|link|draw ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="basketloom", description="Mine recurring gene groups from ordered baskets.")
    kinds = top.add_subparsers(dest="command", required=True)

    run = kinds.add_parser("run", help="pre-process baskets, build and detect modules, fit topics")
    run.add_argument("--out", required=True)
    run.add_argument("--gbks", help="folder of GenBank files")
    run.add_argument("--hmm", help="profiles for the external search program")
    run.add_argument("--domtables", help="folder of domain tables, instead of gbks and hmm")
    run.add_argument("--clusters", help="file of tokenised baskets, instead of all of these")
    run.add_argument("--exclude_name", nargs="+", default=["final"])
    run.add_argument("--include_contig_edge", action="store_true")
    run.add_argument("--max_domain_overlap", type=float, default=0.1)
    run.add_argument("--min_genes", type=int, default=2)
    run.add_argument("--domain_filtering", action="store_true")
    run.add_argument("--include_list", help="file of domain names to keep")
    run.add_argument("--similarity_filtering", action="store_true")
    run.add_argument("--similarity_cutoff", type=float, default=0.95)
    run.add_argument("--no_infrequent_filter", dest="remove_infrequent", action="store_false")
    run.add_argument("--min_gene_occurrence", type=int, default=3)
    run.add_argument("--pval_cutoff", type=float, default=0.01)
    run.add_argument("--modules", help="table of modules to detect, instead of building them")
    run.add_argument("--unfiltered", dest="filtered_for_detection", action="store_false", help="detect modules that occur once, too")
    run.add_argument("--no_stat", dest="statistical", action="store_false")
    run.add_argument("--topic", action="store_true", help="fit and match topics")
    run.add_argument("--topics", type=int, default=1000)
    run.add_argument("--iterations", type=int, default=1000)
    run.add_argument("--chunk", type=int, default=2000)
    run.add_argument("--amplify", type=int, default=1)
    run.add_argument("--min_feature_score", type=float, default=0.95)
    run.add_argument("--features", type=int, default=75)
    run.add_argument("--classes")
    run.add_argument("--known")
    run.add_argument("--topic_model", help="folder of a saved topic model")
    run.add_argument("--resume_topics", type=int, default=0, help="train the saved model on with its own baskets, so many chunks")
    run.add_argument("--update_topics", type=int, default=0, help="train the saved model on with these new baskets, so many chunks")
    run.add_argument("--round_digits", type=int, help="round p-values to so many digits, which merges near cut-offs")
    run.add_argument("--text", action="store_true", help="write the tables as text files, too")
    run.add_argument("--no_reuse", dest="reuse", action="store_false")

    link = kinds.add_parser("link", help="link products to baskets with chosen motifs")
    for name in ("taxonomy", "matches", "out"):
        link.add_argument(f"--{name}", required=True)
    link.add_argument("--products", nargs="+", required=True)
    link.add_argument("--motifs", nargs="+", required=True)
    link.add_argument("--min_genes", type=int, default=0)

    draw = kinds.add_parser("draw", help="draw baskets from domain hits")
    draw.add_argument("--hits", required=True)
    draw.add_argument("--out", required=True)
    draw.add_argument("--colours")
    draw.add_argument("--modules", help="file of matches with >bgc headers; their genes are filled")
    draw.add_argument("--kind", choices=["topic", "stat"], default="topic")
    draw.add_argument("--each", action="store_true", help="one more drawing for each module, instead of one with all of them filled")
    draw.add_argument("--topics", nargs="+", help="only these topics")
    draw.add_argument("--stat_modules", nargs="+", help="only these modules")
    draw.add_argument("--families", nargs="+", help="only modules of these families")
    draw.add_argument("--clans", nargs="+", help="only modules of these clans")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = vars(parser().parse_args(argv))
    spark = spark or SparkSession.builder.appName("basketloom").getOrCreate()
    command = args.pop("command")
    if command == "run":
        from basketloom.plans.pipeline import Config, Run

        run = Run(spark, Config(**args))
        for name, rows in run.run().items():
            print(name, rows.count())
        for name, counts in run.tallies.items():
            print(name, *(f"{status}: {n}" for status, n in counts.items()))
    elif command == "link":
        from basketloom.plans.pipeline import link_products

        print("links", link_products(spark, **args).count())
    else:
        from basketloom.operators import render
        from basketloom.sources import tables

        colours = {r["name"]: (r["r"], r["g"], r["b"]) for r in tables.read_colours(spark, args["colours"]).collect()} if args["colours"] else None
        hits, marked = tables.read_hits(spark, args["hits"]), None
        if args["modules"]:
            blocks = tables.read_module_blocks(spark, args["modules"], args["kind"])
            marked = render.chosen_modules(blocks, args["kind"], args["topics"], args["stat_modules"], args["families"], args["clans"])
        drawn = render.render_modules(hits, marked, colours) if args["each"] and marked is not None else render.render(hits, render.all_genes(marked), colours)
        drawn.write.mode("overwrite").parquet(args["out"])


if __name__ == "__main__":
    main()
