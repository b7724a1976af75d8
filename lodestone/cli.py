"""Command line: ``python -m lodestone.cli COMMAND --help``."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .functions import lexers, tokens
from .operators import evaluation, frequencies, languages, matrices, relational, splitter, swivel, trees
from .plans import conversion, flows
from .session import create_session, stored
from .sources import files as sources
from .sources import git
from .sources import nodes as node_sources

COMMANDS: dict[str, tuple[Callable, list[tuple]]] = {}

REPOS = [(("--input",), {"required": True, "help": "a folder of repositories, or Parquet files with --parquet"}), (("--parquet",), {"action": "store_true"}), (("--languages",), {"nargs": "*"}), (("--blacklist",), {"action": "store_true"}), (("--history",), {"type": int, "help": "read commits: 0 HEAD, n so many before it as well, -1 all; without it the folders' own files"})]
MODE = [(("--mode",), {"choices": ["file", "func", "repo"], "default": "file"})]
DF = [(("--min-docfreq",), {"type": int, "default": 1}), (("--vocabulary-size",), {"type": int, "default": 10_000_000})]
SAVED = [(("--docfreq-in",), {"help": "a saved vocabulary"}), (("--quant",), {"help": "saved quantization levels, made there if there are none"})]
OUT = [(("--output",), {"required": True})]
FEATURES = [(("--features",), {"nargs": "+", "choices": sorted(flows.EXTRACTORS), "required": True})]
FEATURES += [((f"--{e}-weight",), {"type": float, "default": 1.0}) for e in sorted(flows.EXTRACTORS)]
FEATURES += [((f"--{e}-{n.replace('_', '-')}",), {"type": type(v), "default": v}) for e in sorted(flows.EXTRACTORS) for n, v in flows.options_of(e).items()]
MODELS = [(("--inputs",), {"nargs": "+", "required": True})]


def command(name: str, *options):
    def add(f):
        COMMANDS[name] = (f, [o for group in options for o in group])
        return f

    return add


def _files(spark: SparkSession, a) -> DataFrame:
    if a.parquet:
        files = sources.load_parquet(spark, a.input)
    else:
        read = sources.read_repositories(spark, a.input) if a.history is None else git.read_history(spark, a.input, a.history).drop("index")
        files = languages.with_language(read, lexers.extension_table(spark))
    return relational.languages(a.languages, a.blacklist)(files)


def _nodes(spark: SparkSession, a) -> DataFrame:
    """Trees of Python files; with --parquet the table may hold nodes already."""
    table = _files(spark, a)
    if "internal_type" not in table.columns:
        named = table.withColumn("document", F.concat_ws("//", "repository_id", "path"))
        table = node_sources.parsed(named.where(F.col("path").endswith(".py")), "document", "content", node_sources.python_tree)
    mode = getattr(a, "mode", "file")
    if mode == "repo":
        return trees.by_repository(table, F.split_part("document", F.lit("//"), F.lit(1)))
    return trees.by_function(table) if mode == "func" else table


def _bags(spark: SparkSession, a) -> DataFrame:
    """Bags of the features asked for, with the options and weights given for them."""
    nodes = _nodes(spark, a)
    given = {e: {n: getattr(a, f"{e}_{n}") for n in flows.options_of(e)} for e in a.features}
    if "children" in given and getattr(a, "quant", None):
        given["children"]["levels"] = flows.saved_levels(spark, a.quant, nodes, given["children"]["partitions"])
    return flows.bags_of(nodes, a.features, {e: getattr(a, f"{e}_weight") for e in a.features}, given)


@command("preprocrepos", REPOS, OUT)
def preprocess(spark, a):
    sources.save_parquet(_files(spark, a), a.output)


@command("repos2df", REPOS, MODE, FEATURES, DF, SAVED[1:], OUT)
def repos2df(spark, a):
    bags = _bags(spark, a)
    models.save(flows.vocabulary(bags, a.min_docfreq, a.vocabulary_size), a.output, "docfreq", docs=frequencies.n_documents(bags).first()[0])


@command("repos2bow_index", REPOS, MODE, FEATURES, DF, SAVED[1:], OUT)
def repos2bow_index(spark, a):
    bags = _bags(spark, a)
    models.save(frequencies.indexed(bags, "document", "doc_id"), f"{a.output}/documents", "index")
    models.save(flows.vocabulary(bags, a.min_docfreq, a.vocabulary_size), f"{a.output}/docfreq", "docfreq", docs=frequencies.n_documents(bags).first()[0])


@command("repos2bow", REPOS, MODE, FEATURES, DF, SAVED, OUT)
def repos2bow(spark, a):
    bags = _bags(spark, a)
    words, facts = flows.saved_vocabulary(spark, a.docfreq_in, bags, f"{a.output}/docfreq", a.min_docfreq, a.vocabulary_size)
    models.save(flows.repos2bow(bags, words=words), f"{a.output}/bow", "bow", [facts["uuid"]])


@command("repos2ids", REPOS, OUT, [(("--idfreq",), {"action": "store_true"}), (("--split",), {"action": "store_true"})])
def repos2ids(spark, a):
    sources.save_csv(flows.repos2ids(_files(spark, a), a.idfreq, a.split), a.output)


@command("repos2coocc", REPOS, DF, OUT)
def repos2coocc(spark, a):
    models.save(flows.repos2coocc(_nodes(spark, a), a.min_docfreq, a.vocabulary_size), a.output, "cooccurrences")


@command("repos2roleids", REPOS, OUT, [(("--split",), {"action": "store_true"})])
def repos2roleids(spark, a):
    pairs = trees.role_pairs(_nodes(spark, a), split=tokens.processed if a.split else None).where("roles is not null")
    sources.save_csv(pairs.select("token", "roles"), a.output)


@command("repos2id_distance", REPOS, OUT, [(("--type",), {"choices": ["tree", "line"], "default": "tree"}), (("--max-distance",), {"type": int, "default": 10})])
def repos2id_distance(spark, a):
    make = {"tree": trees.tree_distances, "line": trees.line_distances}[a.type]
    sources.save_csv(make(_nodes(spark, a), tokens.split_identifier, a.max_distance).select("first", "second", "distance"), a.output)


@command("repos2idseq", REPOS, MODE, OUT)
def repos2idseq(spark, a):
    sources.save_csv(trees.identifier_sequence(_nodes(spark, a), tokens.split_identifier), a.output)


@command("id2vec-preproc", MODELS, OUT, [(("--docfreq",), {"required": True}), (("--vocabulary-size",), {"type": int, "default": 1 << 17}), (("--shard-size",), {"type": int, "default": 4096})])
def id2vec_preproc(spark, a):
    """Cells of the most frequent words, in whole shards; a matrix of another vocabulary or with negative cells is refused."""
    words, own = models.load(spark, a.docfreq, "docfreq")
    parts = [models.load(spark, p, "cooccurrences") for p in a.inputs]
    for _, meta in parts:
        if meta["dependencies"]:
            models.check_depends(meta, own)
    tables = [swivel.checked(t) for t, _ in parts]
    cells, vocabulary, n = swivel.prepared(matrices.merged_cooccurrences(tables) if len(tables) > 1 else tables[0], words, a.vocabulary_size, a.shard_size)
    models.save(cells, f"{a.output}/cells", "cells", [own["uuid"]], shards=n)
    vocabulary.write.parquet(f"{a.output}/vocabulary")


@command("id2vec-train", OUT, [(("--input",), {"required": True}), (("--dim",), {"type": int, "default": 300}), (("--epochs",), {"type": int, "default": 40}), (("--rate",), {"type": float, "default": 1.0})])
def id2vec_train(spark, a):
    """Row and column vectors of what id2vec-preproc wrote."""
    cells, meta = models.load(spark, f"{a.input}/cells", "cells")
    rows, cols, _ = swivel.trained(cells, spark.read.parquet(f"{a.input}/vocabulary"), meta["shards"], a.dim, a.epochs, options=swivel.Options(rate=a.rate))
    rows.write.parquet(f"{a.output}/rows")
    cols.write.parquet(f"{a.output}/cols")


@command("id2vec-postproc", OUT, [(("--rows",), {"required": True}), (("--cols",), {"required": True})])
def id2vec_postproc(spark, a):
    models.save(matrices.embeddings_of(spark.read.parquet(a.rows), spark.read.parquet(a.cols)), a.output, "id2vec")


@command("id2vec-project", OUT, [(("--input",), {"required": True}), (("--docfreq",), {"help": "without it some of the tokens are taken if there are many"})])
def id2vec_project(spark, a):
    known = models.load(spark, a.docfreq, "docfreq")[0].select("token", "freq") if a.docfreq else None
    matrices.write_projector(matrices.projected(models.load(spark, a.input, "id2vec")[0], known), a.output)


@command("train-id-split", OUT, [(("--input",), {"required": True, "help": "rows of identifier and words"}), (("--test-ratio",), {"type": float, "default": 0.2}), (("--column",), {"default": "token"}), (("--split-column",), {"default": "token_split"}), (("--no-header",), {"action": "store_true"})])
def train_id_split(spark, a):
    """A splitter of names; of the rows held out, by a hash of the name, its precision and recall are written."""
    rows = spark.read.csv(a.input, header=not a.no_header)
    if a.no_header:
        rows = rows.toDF(a.column, a.split_column, *rows.columns[2:])
    rows = rows.select(F.col(a.column).alias("token"), F.col(a.split_column).alias("token_split")).dropDuplicates(["token"])
    held = F.pmod(F.xxhash64("token"), F.lit(1000)) < 1000 * a.test_ratio
    counts, facts = splitter.trained(rows.where(~held))
    models.save(counts, a.output, "splitter", **facts)
    splitter.quality(rows.where(held), (counts, facts)).write.parquet(f"{a.output}/quality")


@command("split-ids", OUT, [(("--input",), {"required": True, "help": "Parquet files with a column token"}), (("--model",), {"required": True})])
def split_ids(spark, a):
    """Names split by a trained splitter."""
    counts, meta = models.load(spark, a.model, "splitter")
    splitter.split_names(sources.load_parquet(spark, a.input), (counts, meta)).write.parquet(a.output)


@command("bow2vw", OUT, [(("--input",), {"required": True})])
def bow2vw(spark, a):
    """Rows (token, document, value) as text lines."""
    sources.save_lines(matrices.bow_lines(sources.load_parquet(spark, a.input)), a.output)


@command("topics2table", OUT, [(("--input",), {"required": True})])
def topics2table(spark, a):
    models.save(matrices.read_topic_text(spark, a.input), a.output, "topics")


@command("merge-df", MODELS, DF, OUT)
def merge_df(spark, a):
    loaded = [models.load(spark, p, "docfreq") for p in a.inputs]
    total = frequencies.merged([t.select("token", "freq") for t, _ in loaded], a.min_docfreq, a.vocabulary_size)
    models.save(frequencies.ordered(total), a.output, "docfreq", docs=sum(m.get("docs", 0) for _, m in loaded))


@command("merge-coocc", MODELS, OUT)
def merge_coocc(spark, a):
    models.save(matrices.merged_cooccurrences([models.load(spark, p, "cooccurrences")[0] for p in a.inputs]), a.output, "cooccurrences")


@command("merge-bow", MODELS, OUT, [(("--features",), {"nargs": "*"}), (("--per-file",), {"action": "store_true", "help": "one result for each input, and a table of what was made"})])
def merge_bow(spark, a):
    """Bags (token, document, value) of several Parquet folders."""
    if a.per_file:
        made = conversion.converted(spark, {p.rstrip("/").rsplit("/", 1)[-1]: p for p in a.inputs}, a.output, conversion.MergedBags(a.features))
        made.write.mode("append").json(f"{a.output}/_status")
        return
    matrices.merged_bows([sources.load_parquet(spark, p) for p in a.inputs], a.features).write.parquet(a.output)


@command("id2role-eval", OUT, [(("--input",), {"required": True}), (("--id2vec",), {"required": True})])
def id2role_eval(spark, a):
    rows = spark.read.option("recursiveFileLookup", True).csv(a.input, header=True).withColumn("roles", F.regexp_replace("roles", r"IDENTIFIER \| | \| IDENTIFIER", ""))
    vectors, _ = models.load(spark, a.id2vec, "id2vec")
    data = evaluation.common_roles(rows, "token", "roles").join(vectors, "token")
    sources.save_csv(evaluation.role_quality(data.withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", "roles"), a.output)


def get_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (handler, options) in COMMANDS.items():
        sub = commands.add_parser(name, help=(handler.__doc__ or "").strip() or None)
        sub.add_argument("--spark", default=None, help="the master")
        sub.add_argument("--memory", default=None, help="executor,driver,results")
        for names, settings in options:
            sub.add_argument(*names, **settings)
        sub.set_defaults(handler=handler)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = get_parser().parse_args(argv)
    args.handler(create_session(f"lodestone-{args.command}", args.spark, args.memory), args)


if __name__ == "__main__":
    main()
