"""One query for each operator over the given tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars, tokens
from .operators import evaluation, frequencies, languages, matrices, relational, splitter, swivel, trees
from .plans import flows, table_functions
from .session import stored
from .sources import files as sources
from .sources import git
from .sources import nodes as trees_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark, d):
    return sources.document_files(_table(spark, d, "documents"))


def _nodes(spark, d):
    return trees_of.order_nodes(_table(spark, d, "orders"), _table(spark, d, "lineitem"))


def _line_bags(spark, d):
    """(token, document, value): quantities of brands in orders."""
    li, part = _table(spark, d, "lineitem"), _table(spark, d, "part")
    joined = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.concat(F.lit("f."), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("token"), F.concat(F.lit("o:"), F.col("l_orderkey").cast("string"), F.lit(" x")).alias("document"), F.col("l_quantity").cast("long").alias("value"))


def _names(spark, d):
    """(token): compound names in several styles."""
    p = _table(spark, d, "part")
    return p.select(F.concat_ws("", F.lower("p_brand"), "p_type", F.initcap("p_name"), F.lit("_"), F.col("p_size").cast("string"), F.lit("HTMLPage")).alias("token")).distinct()


FILES = "files AS (SELECT source AS repository_id, doc_id || '.txt' AS path, md5(coalesce(text, '')) AS blob_id, lang, text AS content FROM documents)"
WORDS = FILES + ", words AS (SELECT unnest(regexp_extract_all(content, '[A-Za-z]+')) AS token, repository_id, repository_id || '//' || path AS document, repository_id || '/' || path AS path FROM files WHERE length(content) > 0)"
TF = WORDS + ", tf AS (SELECT token, document, count(*) AS value FROM words GROUP BY ALL), df AS (SELECT token, count(*) AS freq FROM tf GROUP BY token)"
SPLIT = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z]+'), lambda x: x <> '')"
NAMES = "names AS (SELECT DISTINCT lower(p_brand) || p_type || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || '_' || p_size || 'HTMLPage' AS token FROM part)"
BAGS = "bags AS (SELECT 'f.' || replace(p_brand, '#', '') AS token, 'o:' || l_orderkey || ' x' AS document, CAST(l_quantity AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey), terms AS (SELECT token, document, CAST(sum(value) AS BIGINT) AS value FROM bags GROUP BY ALL)"
NODES = """lines AS (SELECT l_orderkey AS k, l_linenumber AS num, min(l_returnflag) AS flag, min(l_linestatus) AS status, min(l_partkey) AS part FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY flag, num) - 1 AS i, dense_rank() OVER (PARTITION BY k ORDER BY flag) AS g FROM lines JOIN orders ON o_orderkey = k),
nodes AS (
SELECT 'o' || k AS document, 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, 0::BIGINT AS pre, count(*) + max(g) AS post, 'Order' AS internal_type,
 'order' || replace(substr(any_value(o_orderpriority), 3, 20), ' ', '_') AS token, ['FUNCTION', 'DECLARATION'] AS roles, 1 AS line, 0 AS col, []::BIGINT[] AS ancestors FROM r GROUP BY k
UNION ALL SELECT 'o' || k, g, 0, min(i) + g, max(i) + g, 'Group' || flag, 'group' || flag || 'Name', CASE WHEN flag = 'R' THEN ['OPERATOR', 'QUALIFIED'] ELSE ['FUNCTION', 'IDENTIFIER', 'NAME'] END,
 CASE WHEN flag <> 'A' THEN CAST(2 + g AS INTEGER) END, CASE WHEN flag <> 'A' THEN 1 END, [0::BIGINT] FROM r GROUP BY k, g, flag
UNION ALL SELECT 'o' || k, 100 + i, g, i + g + 1, i + g - 1, 'Line' || status, 'line' || flag || 'Status' || status || 'part' || (part % 7), CASE WHEN flag = 'N' AND status = 'F' THEN ['LITERAL'] ELSE ['EXPRESSION', 'IDENTIFIER'] END,
 CASE WHEN num % 2 = 1 THEN num * 4 END, CASE WHEN num % 2 = 1 THEN num END, [0::BIGINT, g] FROM r)"""
#: Words of a token with every part kept, as ``_plain`` splits.
PLAIN = SPLIT
POINTS = (
    NODES
    + ", ids AS (SELECT * FROM nodes WHERE list_contains(roles, 'IDENTIFIER')), chain AS (SELECT document, node_id AS of_, unnest(list_reverse(list_append(ancestors, node_id))) AS node_id, generate_subscripts(list_append(ancestors, node_id), 1) AS d FROM ids), "
    "near AS (SELECT c.document, c.of_, min_by({{'line': n.line, 'col': n.col}}, d) AS place FROM chain c JOIN nodes n ON n.document = c.document AND n.node_id = c.node_id WHERE n.line IS NOT NULL GROUP BY 1, 2), "
    "points AS (SELECT i.document, i.node_id, i.post, i.ancestors, place.line AS line, place.col AS col, unnest({0}) AS token, generate_subscripts({0}, 1) AS k FROM ids i LEFT JOIN near n ON n.document = i.document AND n.of_ = i.node_id)"
).replace("{{", "{").replace("}}", "}").replace("{0}", SPLIT.replace("{0}", "i.token"))


def _merged(words: str, least: int) -> str:
    """SQL of the words with those shorter than ``least`` joined to their long neighbours."""
    long = f"length(ws[i]) >= {least}"
    before = "i > 1 AND length(ws[i - 1])"
    joined = "[ws[i - 1] || ws[i]]"
    each = f"CASE WHEN {long} THEN list_concat([ws[i]], CASE WHEN {before} < {least} THEN {joined} ELSE [] END) WHEN {before} >= {least} THEN {joined} ELSE [ws[i]] END"
    return f"flatten(list_transform(range(1, len({words}) + 1), lambda i: {each.replace('ws', words)}))"


#: Words of a token as the flows process them; of the words that occur one has a stem of its own.
PROCESSED = "list_transform({0}, lambda x: replace(x, 'specified', 'specifi'))"
GREEDY = """h AS (SELECT internal_type, n_children AS n, count(*) AS f FROM kids GROUP BY ALL),
hist AS (SELECT *, row_number() OVER (PARTITION BY internal_type ORDER BY n) AS k, sum(f) OVER (PARTITION BY internal_type)::DOUBLE / {0} AS cap, max(n) OVER (PARTITION BY internal_type) AS last FROM h),
cuts AS (SELECT internal_type, k, [n] AS made, f::BIGINT AS since FROM hist WHERE k = 1 UNION ALL SELECT c.internal_type, x.k, CASE WHEN since + f > cap AND len(made) < {0} + 1 THEN list_append(made, n) ELSE made END, CASE WHEN since + f > cap THEN f ELSE since + f END
 FROM cuts c JOIN hist x ON x.internal_type = c.internal_type AND x.k = c.k + 1),
quant AS (SELECT c.internal_type, CASE WHEN len(made) < {0} + 1 THEN list_concat(made, list_transform(range({0} + 1 - len(made)), lambda z: last)) ELSE list_append(made[:{0}], last) END AS levels
 FROM cuts c JOIN hist x USING (internal_type, k) QUALIFY row_number() OVER (PARTITION BY c.internal_type ORDER BY k DESC) = 1)"""


def _plain(token):
    return tokens.split_identifier(token, single_shot=True, least=1)


# frequencies


@query(f"WITH {TF} SELECT token, document, value FROM tf")
def term_freq(spark, d):
    return frequencies.term_frequency(flows.word_bags(_files(spark, d)))


@query(f"WITH {TF} SELECT token, freq FROM df")
def doc_freq(spark, d):
    return frequencies.document_frequency(flows.word_bags(_files(spark, d)))


@query(f"WITH {TF} SELECT token, freq FROM df WHERE freq >= 5")
def doc_freq_prune(spark, d):
    return frequencies.pruned(doc_freq(spark, d), 5)


@query(f"WITH {TF} SELECT token, freq FROM df ORDER BY freq DESC, token LIMIT 500")
def doc_freq_greatest(spark, d):
    return frequencies.greatest(doc_freq(spark, d), 500)


@query(f"WITH {TF} SELECT token, document, round(ln(1 + value) * ln((SELECT count(DISTINCT document) FROM tf)::DOUBLE / freq), 6) AS value FROM tf JOIN df USING (token)")
def tfidf_words(spark, d):
    return flows.tf_idf_words(_files(spark, d)).withColumn("value", F.round("value", 6))


@query(f"WITH {TF} SELECT token, freq, row_number() OVER (ORDER BY token) - 1 AS token_id FROM df")
def vocab_index(spark, d):
    return frequencies.ordered(doc_freq(spark, d))


@query("SELECT source AS token, arg_max(n_chars, doc_id) AS freq FROM documents WHERE source IS NOT NULL GROUP BY source")
def doc_freq_last(spark, d):
    rows = _table(spark, d, "documents").select(F.col("source").alias("token"), F.col("n_chars").alias("freq"), "doc_id")
    return frequencies.constructed(rows, "doc_id")


@query(f"WITH {WORDS}, df AS (SELECT repository_id, token, count(DISTINCT document) AS freq FROM words GROUP BY ALL) SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM df GROUP BY token HAVING sum(freq) >= 3")
def merge_df(spark, d):
    files = _files(spark, d)
    english = flows.word_bags(files.where("lang = 'en'"))
    rest = flows.word_bags(files.where("lang <> 'en' or lang is null"))
    return frequencies.merged([frequencies.document_frequency(english), frequencies.document_frequency(rest)], least=3)


@query(f"WITH {WORDS} SELECT count(DISTINCT path) AS num_files, count(*) AS num_occ, count(DISTINCT repository_id) AS num_repos, token, array_to_string({SPLIT.format('token')}, ' ') AS token_split FROM words GROUP BY token")
def idfreq(spark, d):
    return frequencies.identifier_frequencies(flows.word_identifiers(_files(spark, d)), _plain(F.col("token")))


@query(f"WITH {WORDS} SELECT DISTINCT token, array_to_string({SPLIT.format('token')}, ' ') AS token_split FROM words")
def ids_distinct(spark, d):
    return frequencies.distinct_identifiers(flows.word_identifiers(_files(spark, d)), _plain(F.col("token")))


def _code(spark, d):
    """Python and Java files with names, strings, comments, keywords and numbers."""
    p = _table(spark, d, "part")
    name, words = F.concat(F.lit("find"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_by"), F.initcap("p_type")), F.col("p_name")
    python = F.concat(F.lit("def "), name, F.lit("(size):  # "), words, F.lit("\n    return size + 0x1F if None else '"), words, F.lit("'\n"))
    java = F.concat(F.lit("/* "), words, F.lit(" */ public int "), name, F.lit('(int size) { return size + 12e3; } // "'), words, F.lit("\n"))
    lang = F.when(F.col("p_partkey") % 3 == 0, "Python").when(F.col("p_partkey") % 3 == 1, "Java").otherwise("Markdown")
    return p.select(F.col("p_brand").alias("repository_id"), F.col("p_partkey").cast("string").alias("path"), lang.alias("lang"), F.when(lang == "Java", java).otherwise(python).alias("content"))


CODE = "code AS (SELECT 'find' || replace(p_brand, '#', '') || '_by' || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS phrase, p_brand AS repository_id, p_brand || '/' || p_partkey AS path FROM part WHERE p_partkey % 3 <> 2)"


@query(f"""WITH {CODE}, n AS (SELECT string_split(phrase, ' ')[1] AS token, repository_id, path FROM code UNION ALL SELECT unnest(string_split(phrase, ' ')[2:]), repository_id, path FROM code UNION ALL SELECT unnest(['size', 'size']), repository_id, path FROM code)
SELECT token, count(DISTINCT path) AS num_files, count(*) AS num_occ, count(DISTINCT repository_id) AS num_repos FROM n GROUP BY token""")
def source_names(spark, d):
    return flows.repos2ids(_code(spark, d), split=False).select("token", "num_files", "num_occ", "num_repos")


@query("""WITH own AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z_]+|[^\\x20\\x09-\\x0DA-Za-z_0-9]')) AS token FROM documents) GROUP BY ALL),
seen AS (SELECT lang, token, sum(n) AS n FROM own JOIN documents USING (doc_id) WHERE lang IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM seen GROUP BY lang), files AS (SELECT lang, count(*) AS files FROM documents WHERE lang IS NOT NULL GROUP BY lang),
langs AS (SELECT lang, ln(files / (SELECT sum(files) FROM files)::DOUBLE) AS prior, ln(0.5 / (total + 0.5 * ((SELECT count(DISTINCT token) FROM seen) + 1))) AS floor FROM files JOIN totals USING (lang)),
sizes AS (SELECT doc_id, sum(n) AS tokens FROM own GROUP BY doc_id),
gains AS (SELECT doc_id, lang, sum(own.n * ln((seen.n + 0.5) / 0.5)) AS gain FROM own JOIN seen USING (token) GROUP BY ALL),
scored AS (SELECT d.doc_id, l.lang, prior + coalesce(tokens, 0) * floor + coalesce(gain, 0) AS score
 FROM documents d CROSS JOIN langs l LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN gains g ON g.doc_id = d.doc_id AND g.lang = l.lang)
SELECT doc_id, arg_max(lang, score) AS lang FROM scored GROUP BY doc_id""")
def language_by_content(spark, d):
    """The language that a model of all documents gives each by its words and marks."""
    docs = _table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    model = languages.language_model(docs)
    return languages.classified(docs.select("doc_id", "content", F.lit(None).cast("array<string>").alias("candidates")), model, "doc_id")


# tokens


@query(f"WITH {NAMES} SELECT token, array_to_string({SPLIT.format('token')}, ' ') AS words FROM names")
def token_split(spark, d):
    return _names(spark, d).select("token", F.array_join(_plain(F.col("token")), " ").alias("words"))


@query(f"WITH {NAMES} SELECT token, array_to_string({SPLIT.replace('([A-Z])([A-Z][a-z])', '([A-Z][A-Z])([a-z])').format('token')}, ' ') AS words FROM names")
def token_split_no_attach(spark, d):
    return _names(spark, d).select("token", F.array_join(tokens.split_identifier(F.col("token"), attach_upper=False, single_shot=True, least=1), " ").alias("words"))


@query(f"WITH {NAMES} SELECT token, array_to_string(list_filter({SPLIT.format('token')}, lambda x: length(x) >= 5), ' ') AS words FROM names")
def token_split_single_shot(spark, d):
    return _names(spark, d).select("token", F.array_join(tokens.split_identifier(F.col("token"), single_shot=True, least=5), " ").alias("words"))


@query(f"WITH {NAMES}, s AS (SELECT token, {SPLIT.format('token')} AS ws FROM names) SELECT token, array_to_string({_merged('ws', 6)}, ' ') AS words FROM s")
def token_merge_short(spark, d):
    return _names(spark, d).select("token", F.array_join(tokens.split_identifier(F.col("token"), least=6), " ").alias("words"))


@query()
def token_stems(spark, d):
    words = flows.word_identifiers(_files(spark, d)).select(F.lower("token").alias("word")).distinct()
    return tokens.stemmed(words.withColumn("stem", F.col("word")), "stem")


@query(f"WITH {NAMES} SELECT token, token AS rebuilt FROM names")
def token_reconstruct(spark, d):
    return _names(spark, d).select("token", tokens.reconstruct(tokens.styled_parts(F.col("token"))).alias("rebuilt"))


# rows


@query(f"WITH {FILES} SELECT repository_id, path, lang FROM files WHERE lang IN ('de', 'fr')")
def lang_whitelist(spark, d):
    return relational.languages(["de", "fr"])(_files(spark, d)).select("repository_id", "path", "lang")


@query(f"WITH {FILES} SELECT repository_id, path, lang FROM files WHERE lang NOT IN ('de', 'fr')")
def lang_blacklist(spark, d):
    return relational.languages(["de", "fr"], blacklist=True)(_files(spark, d)).select("repository_id", "path", "lang")


@query(f"WITH {FILES} SELECT repository_id, path FROM files WHERE regexp_matches(repository_id, '1[0-3]?$')")
def repo_filter(spark, d):
    return relational.repositories_like("1[0-3]?$")(_files(spark, d)).select("repository_id", "path")


def _history(spark, d):
    o = _table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("commit_hash"), F.col("o_orderdate").alias("commit_time"), F.col("o_orderpriority").alias("path"))


HISTORY = "SELECT repository_id, commit_hash, path FROM (SELECT o_custkey AS repository_id, o_orderkey AS commit_hash, o_orderpriority AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= {0}"


@query(HISTORY.format(3))
def history_depth(spark, d):
    return relational.history_files(_history(spark, d), 2).select("repository_id", "commit_hash", "path")


@query(HISTORY.format(1))
def head_files(spark, d):
    return relational.head_files(_history(spark, d)).select("repository_id", "commit_hash", "path")


@query("""WITH line AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS n FROM orders)
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS repository_id, 'c' || o_orderkey AS commit_hash, n AS index, l_returnflag || '/' || l_linestatus || '/' || l_linenumber || '.txt' AS path, '100644' AS mode, 'b' || l_partkey AS blob_id
FROM line JOIN lineitem ON l_orderkey = o_orderkey WHERE n <= 5""")
def history_trees(spark, d):
    """Files of six commits of each repository, from commits with parents and trees: customers, their orders, the lines of an order by flag and status."""
    o, li = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    parents = F.array_compact(F.array(F.lag(name("c", "o_orderkey")).over(before), F.lag(name("c", "o_orderkey"), 2).over(before)))
    commits = o.select(F.col("o_custkey").cast("string").alias("repository_id"), name("c", "o_orderkey").alias("commit"), name("t", "o_orderkey").alias("tree"), parents.alias("parents"), F.lead("o_orderkey").over(before).isNull().alias("last"))
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("string").alias("repository_id"), "o_orderkey", name("t", "o_orderkey").alias("top"), "l_returnflag", "l_linestatus", name("", "l_linenumber").alias("line"), name("b", "l_partkey").alias("blob"))
    flag, status = F.concat_ws("/", "top", "l_returnflag"), F.concat_ws("/", "top", "l_returnflag", "l_linestatus")
    entry = lambda tree, mode, label, object_id: F.struct(tree.alias("tree"), F.lit(mode).alias("mode"), label.alias("name"), object_id.alias("object_id"))
    three = F.array(entry(F.col("top"), "40000", F.col("l_returnflag"), flag), entry(flag, "40000", F.col("l_linestatus"), status), entry(status, "100644", F.concat("line", F.lit(".txt")), F.col("blob")))
    # by order, as the join has dealt the lines: not dealt again
    entries = lines.select("o_orderkey", "repository_id", F.explode(three).alias("e")).select("o_orderkey", "repository_id", "e.*").distinct().drop("o_orderkey")
    return git.history_files(stored(commits, "commits"), stored(entries, "entries"), commits.where("last").select("repository_id", "commit"), 5)


@query(f"WITH {FILES} SELECT repository_id || '//' || path || '@' || blob_id AS document FROM files")
def document_name(spark, d):
    return _files(spark, d).select(scalars.document_name(F.col("repository_id"), F.col("path"), F.col("blob_id")).alias("document"))


@query(f"WITH {FILES} SELECT blob_id, min(path) AS path FROM files GROUP BY blob_id")
def dedup_blob(spark, d):
    return relational.distinct_blobs(_files(spark, d).select("blob_id", "path", "lang"), order="path").select("blob_id", "path")


@query(f"WITH {FILES} SELECT count(*) AS n FROM (SELECT DISTINCT lang, content FROM files)")
def counter_distinct(spark, d):
    return relational.counted(distinct=True, columns=["lang", "content"])(_files(spark, d))


@query()
def counter_approx(spark, d):
    return relational.counted(distinct=True, approximate=True, columns=["lang", "content"])(_files(spark, d))


@query()
def sample(spark, d):
    return relational.sample(0.05, 42)(_table(spark, d, "lineitem"))


# trees


@query(f"WITH {NODES} SELECT document, node_id, parent_id, pre, post, internal_type, token, array_to_string(roles, ',') AS roles, line, col, CAST(len(ancestors) AS INTEGER) AS depth FROM nodes")
def nodes_table(spark, d):
    return _nodes(spark, d).select("document", "node_id", "parent_id", "pre", "post", "internal_type", "token", F.array_join("roles", ",").alias("roles"), "line", "col", F.size("ancestors").alias("depth"))


@query(f"WITH {NODES}, w AS (SELECT document, unnest({SPLIT.format('token')}) AS token FROM nodes WHERE list_contains(roles, 'IDENTIFIER')) SELECT 'i.' || token AS token, document, count(*)::DOUBLE AS value FROM w GROUP BY ALL")
def bag_id(spark, d):
    return trees.with_namespace(trees.identifier_bag(_nodes(spark, d), _plain), "i.")


@query(f"WITH {NODES} SELECT 'l.' || substr(md5(token), 1, 16) AS token, document, count(*)::DOUBLE AS value FROM nodes WHERE list_contains(roles, 'LITERAL') GROUP BY ALL")
def bag_lit(spark, d):
    return trees.with_namespace(trees.literal_bag(_nodes(spark, d), tokens.hashed_token), "l.")


@query(f"""WITH {NODES}, n AS (SELECT document, internal_type AS a, lead(internal_type, 1) OVER w AS b, lead(internal_type, 2) OVER w AS c, lead(internal_type, 3) OVER w AS e FROM nodes WINDOW w AS (PARTITION BY document ORDER BY post)),
g AS (SELECT document, a || '>' || b || '>' || c AS token FROM n WHERE c IS NOT NULL UNION ALL SELECT document, a || '>' || b || '>' || c || '>' || e FROM n WHERE e IS NOT NULL) SELECT 's.' || token AS token, document, count(*)::DOUBLE AS value FROM g GROUP BY ALL""")
def bag_seq(spark, d):
    return trees.with_namespace(trees.sequence_bag(_nodes(spark, d)), "s.")


@query(f"""WITH {NODES}, c AS (SELECT document, parent_id AS node_id, string_agg(internal_type, '_' ORDER BY internal_type) AS kids FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL)
SELECT 'g.' || concat_ws('_', coalesce(p.internal_type, 'None'), n.internal_type, kids) AS token, n.document, count(*)::DOUBLE AS value FROM nodes n LEFT JOIN nodes p ON p.document = n.document AND p.node_id = n.parent_id LEFT JOIN c ON c.document = n.document AND c.node_id = n.node_id GROUP BY ALL""")
def bag_graphlet(spark, d):
    return trees.with_namespace(trees.graphlet_bag(_nodes(spark, d)), "g.")


def _sql_bag(spark, d, kind):
    nodes = table_functions.with_words(_nodes(spark, d), _plain)
    return table_functions.sql_bag(nodes, kind).where("error is null").select("token", "document", "value")


@query(ORACLE_SQL["bag_id"])
def sql_bag_id(spark, d):
    """The bag of identifiers through the table function of SQL."""
    return _sql_bag(spark, d, "id")


@query(ORACLE_SQL["bag_seq"])
def sql_bag_seq(spark, d):
    return _sql_bag(spark, d, "uast2seq")


@query(ORACLE_SQL["bag_graphlet"])
def sql_bag_graphlet(spark, d):
    return _sql_bag(spark, d, "graphlet")


CHILDREN = f"{NODES}, c AS (SELECT document, parent_id AS node_id, count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL), kids AS (SELECT n.document, internal_type, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN c USING (document, node_id))"


def _histogram(spark, d):
    return trees.child_counts(_nodes(spark, d)).groupBy("internal_type", "n_children").agg(F.count("*").alias("freq"))


@query(f"WITH {CHILDREN} SELECT internal_type, n_children, count(*) AS freq FROM kids GROUP BY ALL")
def child_histogram(spark, d):
    return _histogram(spark, d)


@query(f"WITH {CHILDREN} SELECT 'c.' || internal_type || '_' || CAST(len(list_filter([0, 1, 2, 4, 8], lambda x: x <= n_children)) - 1 AS VARCHAR) AS token, document, count(*)::DOUBLE AS value FROM kids GROUP BY ALL")
def bag_children(spark, d):
    nodes = _nodes(spark, d)
    levels = nodes.select("internal_type").distinct().withColumn("levels", F.array(*[F.lit(x).cast("long") for x in (0, 1, 2, 4, 8)]))
    return trees.with_namespace(trees.children_bag(nodes, levels), "c.")


@query(f"WITH RECURSIVE {CHILDREN}, {GREEDY.format(4)} SELECT internal_type, array_to_string(levels, ',') AS levels FROM quant")
def quant_levels(spark, d):
    return trees.quantization_levels(_histogram(spark, d), 4).select("internal_type", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"))


WALKS = f"""WITH RECURSIVE {NODES}, c AS (SELECT document, parent_id AS node_id, list({{'id': node_id, 'kind': internal_type}} ORDER BY node_id) AS kids FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL),
near AS (SELECT n.document, n.node_id AS spot, list_concat(coalesce(kids, []), CASE WHEN p.node_id IS NULL THEN [] ELSE [{{'id': p.node_id, 'kind': p.internal_type}}] END) AS near, coalesce(len(kids), 0) AS k
 FROM nodes n LEFT JOIN c USING (document, node_id) LEFT JOIN nodes p ON p.document = n.document AND p.node_id = n.parent_id),
walks AS (SELECT document, node_id AS first, walk, node_id AS spot, node_id AS before, [internal_type] AS path, 1 AS step FROM nodes, range(2) AS r(walk)
 UNION ALL SELECT document, first, walk, go.id, spot, list_append(path, go.kind), step + 1 FROM (SELECT w.*, CASE WHEN len(near) = 0 THEN {{'id': w.spot, 'kind': path[step]}}
  WHEN step > 1 AND ('0x' || substr(md5(concat_ws('/', 42, w.document, first, walk, step, 'back')), 1, 8))::BIGINT / 4294967296::DOUBLE < (1 / 0.79::DOUBLE) / ((1 / 0.79::DOUBLE) + k / 0.82::DOUBLE) THEN {{'id': before, 'kind': path[step - 1]}}
  ELSE near[('0x' || substr(md5(concat_ws('/', 42, w.document, first, walk, step, 'next')), 1, 8))::BIGINT % len(near) + 1] END AS go FROM walks w JOIN near n ON n.document = w.document AND n.spot = w.spot WHERE step < 10)),
grams AS (SELECT document, unnest(list_concat(list_transform(range(1, 10), lambda i: array_to_string(path[i:i + 1], '>')), list_transform(range(1, 9), lambda i: array_to_string(path[i:i + 2], '>')))) AS token FROM walks WHERE step = 10)
SELECT 'r.' || token AS token, document, count(*)::DOUBLE AS value FROM grams GROUP BY ALL"""


@query(WALKS)
def random_walk_bag(spark, d):
    return trees.with_namespace(trees.random_walk_bag(_nodes(spark, d)), "r.")


@query(f"""WITH {NODES}, ids AS (SELECT document, node_id, token, unnest(list_reverse(list_append(ancestors, node_id))) AS up, generate_subscripts(list_append(ancestors, node_id), 1) AS d FROM nodes WHERE list_contains(roles, 'IDENTIFIER')),
says AS (SELECT document, node_id AS up, array_to_string(list_sort(roles), ' | ') AS roles FROM nodes WHERE len(list_filter(roles, lambda r: NOT list_contains(['EXPRESSION', 'IDENTIFIER', 'LEFT', 'QUALIFIED', 'BINARY', 'ASSIGNMENT'], r))) > 0 AND NOT list_contains(roles, 'OPERATOR')),
best AS (SELECT ids.document, ids.node_id, ids.token, min_by(says.roles, d) AS roles FROM ids LEFT JOIN says USING (document, up) GROUP BY ALL) SELECT token, roles, count(*) AS n FROM best GROUP BY ALL""")
def role_pairs(spark, d):
    return trees.role_pairs(_nodes(spark, d)).groupBy("token", "roles").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT greatest(a.token, b.token) AS first, least(a.token, b.token) AS second, abs(a.line - b.line)::BIGINT AS distance, count(*) AS n FROM points a JOIN points b ON a.document = b.document AND (a.node_id, a.k) < (b.node_id, b.k) AND a.token <> b.token WHERE abs(a.line - b.line) < 10 GROUP BY ALL")
def id_line_distance(spark, d):
    return trees.line_distances(_nodes(spark, d), _plain).groupBy("first", "second", "distance").agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS}, p AS (SELECT a.token AS x, b.token AS y, a.ancestors AS u, b.ancestors AS v, least(len(a.ancestors), len(b.ancestors)) AS n FROM points a JOIN points b ON a.document = b.document AND (a.node_id, a.k) < (b.node_id, b.k) AND a.token <> b.token),
q AS (SELECT x, y, len(u) + len(v) - 2 * CASE WHEN n = 0 THEN 0 WHEN n >= 1 AND u[1] <> v[1] THEN 0 WHEN n >= 2 AND u[2] <> v[2] THEN 1 ELSE n - 1 END AS distance FROM p) SELECT greatest(x, y) AS first, least(x, y) AS second, distance::BIGINT AS distance, count(*) AS n FROM q WHERE distance < 10 GROUP BY ALL""")
def id_tree_distance(spark, d):
    return trees.tree_distance_counts(_nodes(spark, d), _plain)


@query(f"WITH {POINTS} SELECT document, string_agg(token, ' ' ORDER BY coalesce(line, 0), coalesce(col, 0), -post, k) AS sequence FROM points GROUP BY document")
def id_sequence(spark, d):
    return trees.identifier_sequence(_nodes(spark, d), _plain)


@query(f"WITH {NODES} SELECT o_orderstatus AS document, internal_type, count(*) AS n FROM nodes JOIN orders ON document = 'o' || o_orderkey GROUP BY ALL")
def mode_repo(spark, d):
    o = _table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("document"), "o_orderstatus")
    nodes = _nodes(spark, d).join(o, "document")
    return trees.by_repository(nodes, F.col("o_orderstatus")).groupBy("document", "internal_type").agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, names AS (SELECT document, string_agg(token, '+' ORDER BY pre) AS name FROM nodes WHERE list_contains(roles, 'NAME') GROUP BY document)
SELECT n.document || '_' || name || ':1' AS document, count(*) AS n FROM nodes n JOIN names USING (document) GROUP BY ALL""")
def mode_func(spark, d):
    return trees.by_function(_nodes(spark, d)).groupBy("document").agg(F.count("*").alias("n"))


@query()
def html_nodes(spark, d):
    pages = _table(spark, d, "pages")
    return trees_of.parsed(pages, "page_id", "html", trees_of.html_tree).groupBy("document").agg(F.count("*").alias("n"), F.max(F.size("ancestors")).alias("depth"))


# matrices


COOC = "{0}, n AS (SELECT document AS context, token, count(*) AS n FROM (SELECT document, unnest({1}) AS token FROM nodes WHERE list_contains(roles, 'IDENTIFIER')) GROUP BY ALL), cooc AS (SELECT a.token AS \"row\", b.token AS col, CAST(sum(a.n * (b.n - CASE WHEN a.token = b.token THEN 1 ELSE 0 END)) AS BIGINT) AS weight FROM n a JOIN n b USING (context) GROUP BY ALL HAVING weight > 0)".format(NODES, SPLIT.format("token"))


def _cooc(spark, d):
    ids = _nodes(spark, d).where(trees.has_roles("IDENTIFIER"))
    return matrices.cooccurrence(ids.select(F.col("document").alias("context"), F.explode(_plain(F.col("token"))).alias("token")))


@query(f"WITH {COOC} SELECT \"row\", col, weight FROM cooc")
def cooc(spark, d):
    return _cooc(spark, d)


@query(f"""WITH {NODES}, ids AS (SELECT document, node_id, ancestors, {SPLIT.format('token')} AS words FROM nodes WHERE list_contains(roles, 'IDENTIFIER')),
up AS (SELECT document, node_id, unnest(ancestors) AS up, generate_subscripts(ancestors, 1) AS d FROM ids), near AS (SELECT up.document, up.node_id, max_by(up.up, up.d) AS near FROM up JOIN ids i ON i.document = up.document AND i.node_id = up.up GROUP BY ALL),
c AS (SELECT document, node_id AS ctx, words FROM ids UNION ALL SELECT i.document, coalesce(n.near, i.ancestors[1]), words FROM ids i LEFT JOIN near n ON n.document = i.document AND n.node_id = i.node_id), t AS (SELECT document, ctx, unnest(words) AS token FROM c),
n AS (SELECT document, ctx, token, count(*) AS n FROM t GROUP BY ALL) SELECT a.token AS "row", b.token AS col, CAST(sum(a.n * (b.n - CASE WHEN a.token = b.token THEN 1 ELSE 0 END)) AS BIGINT) AS weight FROM n a JOIN n b USING (document, ctx) GROUP BY ALL HAVING weight > 0""")
def cooc_trees(spark, d):
    return matrices.Contexts(_nodes(spark, d), _plain).cooccurrence()


@query(f"WITH {COOC} SELECT \"row\", col, CAST(least(2147483647, 2 * least(weight * 100000, 2147483647)) AS BIGINT) AS weight FROM cooc")
def cooc_merge_saturated(spark, d):
    part = _cooc(spark, d).withColumn("weight", F.col("weight") * 100_000)
    return matrices.merged_cooccurrences([part, part])


@query(f"""WITH {BAGS}, vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM (SELECT DISTINCT token FROM terms)) SELECT document, string_agg(token_id || ':' || value, ' ' ORDER BY token_id) AS cells FROM terms JOIN vocab USING (token) GROUP BY document""")
def bow_rows(spark, d):
    tf = frequencies.term_frequency(_line_bags(spark, d))
    rows = matrices.bow_rows(tf, frequencies.indexed(tf))
    return rows.select("document", F.array_join(F.zip_with("tokens", "values", lambda t, v: F.concat_ws(":", t.cast("string"), v.cast("string"))), " ").alias("cells"))


@query(f"WITH {BAGS} SELECT replace(replace(document, ':', ''), ' ', '_') || ' ' || string_agg(token || ':' || value, ' ' ORDER BY token) AS line FROM terms GROUP BY document")
def bow_vw(spark, d):
    return matrices.bow_lines(frequencies.term_frequency(_line_bags(spark, d)))


@query(f"WITH {BAGS} SELECT token, document, value FROM terms UNION ALL SELECT token, 'second ' || document, value FROM terms")
def bow_merge(spark, d):
    tf = frequencies.term_frequency(_line_bags(spark, d))
    other = tf.select(F.replace("token", F.lit("f."), F.lit("k.")).alias("token"), "document", "value")
    return matrices.merged_bows([tf, other, tf.withColumn("document", F.concat(F.lit("second "), "document"))], ["f."])


@query(f"WITH {BAGS} SELECT round(avg(n), 6) AS mean_tokens FROM (SELECT document, count(*) AS n FROM terms GROUP BY document)")
def bow_average(spark, d):
    return matrices.average_bag(frequencies.term_frequency(_line_bags(spark, d))).select(F.round("mean_tokens", 6).alias("mean_tokens"))


@query(f"WITH {COOC}, rsum AS (SELECT \"row\", count(*) AS rs FROM cooc GROUP BY ALL), csum AS (SELECT col, count(*) AS cs FROM cooc GROUP BY ALL) SELECT \"row\", col, round(ln(weight) - ln(rs + 1) - ln(cs + 1) + ln((SELECT sum(rs) FROM rsum)::DOUBLE + 1), 6) AS target, round(0.1 + 0.25 * sqrt(weight), 6) AS confidence FROM cooc JOIN rsum USING (\"row\") JOIN csum USING (col)")
def pmi_target(spark, d):
    return matrices.pmi_targets(_cooc(spark, d)).select("row", "col", F.round("target", 6).alias("target"), F.round("confidence", 6).alias("confidence"))


#: Kinds of parts (brand and size) that are ordered together, most pairs of which never are; vectors that follow from the names;
#: shards by falling number of cells; every pair of names with its cell and error.
SWIVEL = """n AS (SELECT l_orderkey AS context, replace(p_brand, '#', '') || '-' || p_size AS token, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
cooc AS (SELECT a.token AS "row", b.token AS col, sum(a.n * (b.n - CASE WHEN a.token = b.token THEN 1 ELSE 0 END))::DOUBLE AS weight FROM n a JOIN n b USING (context) GROUP BY ALL HAVING weight > 0),
sums AS (SELECT "row" AS token, count(*) AS n FROM cooc GROUP BY ALL),
v AS (SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) - 1) % 3 AS shard, [length(token) / 10::DOUBLE, ascii(token[6]) / 100::DOUBLE - 1, 0.25] AS r,
 [0.5, length(token) / 20::DOUBLE, ascii(token[7]) / 50::DOUBLE - 2] AS c FROM sums),
pairs AS (SELECT a.token AS x, b.token AS y, a.shard AS i, b.shard AS j, a.r, b.c, w.weight,
 list_inner_product(a.r, b.c) + ln(1 + a.n) + ln(1 + b.n) - ln(1 + (SELECT sum(n) FROM sums)::DOUBLE) - CASE WHEN w.weight IS NULL THEN 0 ELSE ln(w.weight) END AS err
 FROM v a CROSS JOIN v b LEFT JOIN cooc w ON w."row" = a.token AND w.col = b.token)"""
SWIVEL_LOSS = f"""WITH {SWIVEL} SELECT CAST(i AS INTEGER) AS row_shard, CAST(j AS INTEGER) AS col_shard,
 round(sum(CASE WHEN weight IS NULL THEN 0 ELSE 0.5 * (0.1 + 0.25 * sqrt(weight)) * err * err END) / 4096, 6) AS l2,
 round(sum(CASE WHEN weight IS NULL THEN ln(1 + exp(err)) ELSE 0 END) / 4096, 6) AS zeros FROM pairs GROUP BY ALL"""
SWIVEL_STEP = f"""WITH {SWIVEL},
slopes AS (SELECT *, CASE WHEN weight IS NULL THEN 1 / (1 + exp(-err)) ELSE (0.1 + 0.25 * sqrt(weight)) * err END / 4096::DOUBLE AS g FROM pairs WHERE i = j),
sides AS (SELECT 'row' AS side, x AS token, k, any_value(r[k]) AS was, sum(g * c[k]) AS g FROM slopes, range(1, 4) AS ks(k) GROUP BY ALL
 UNION ALL SELECT 'col', y, k, any_value(c[k]), sum(g * r[k]) FROM slopes, range(1, 4) AS ks(k) GROUP BY ALL)
SELECT side, token, string_agg(printf('%.5f', was - g / sqrt(0.1 + g * g)), ' ' ORDER BY k) AS vector FROM sides GROUP BY ALL"""


def _swivel(spark, d):
    """(vectors from the names in 3 shards, cells by row) of kinds of parts in orders."""
    li, part = _table(spark, d, "lineitem"), _table(spark, d, "part")
    kind = F.concat_ws("-", F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_size").cast("string"))
    words = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("context"), kind.alias("token"))
    cooc = stored(matrices.cooccurrence(words), "cooc")
    places = stored(swivel.placed(cooc, cooc.select(F.col("row").alias("token")).distinct(), 3), "sides")
    length, code = F.length("token").cast("double"), lambda i: F.ascii(F.substring("token", i, 1)).cast("double")
    vector = F.when(F.col("side") == "row", F.array(length / 10, code(6) / 100 - 1, F.lit(0.25))).otherwise(F.array(F.lit(0.5), length / 20, code(7) / 50 - 2))
    return places.withColumn("vector", vector).withColumn("squares", F.array_repeat(F.lit(0.1), 3)), swivel.cells_by_row(cooc, places)


@query(SWIVEL_LOSS)
def swivel_loss(spark, d):
    """The losses of each block of three shards, with those of the zero cells."""
    made = swivel.block_losses(*_swivel(spark, d), 3)
    return made.select("row_shard", "col_shard", F.round("l2", 6).alias("l2"), F.round("zeros", 6).alias("zeros"))


@query(SWIVEL_STEP)
def swivel_step(spark, d):
    """One step of training: the blocks (i, i) of three shards."""
    vectors, cells = _swivel(spark, d)
    made = swivel.step(vectors, cells, 3, 0, swivel.log_of_all(vectors)).where("side in ('row', 'col')")
    return made.select("side", "token", F.array_join(F.transform("vector", lambda x: F.format_string("%.5f", x)), " ").alias("vector"))


@query(f"WITH {COOC}, s AS (SELECT \"row\" AS token, count(*) AS sums FROM cooc GROUP BY ALL) SELECT token, sums, CAST((row_number() OVER (ORDER BY sums DESC, token) - 1) % 4 AS INTEGER) AS shard FROM s")
def shard_assign(spark, d):
    c = _cooc(spark, d)
    return matrices.shards(c, c.select(F.col("row").alias("token")).distinct(), 4)


@query("SELECT CAST(label AS VARCHAR) || '.' || vec_id AS token, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE + 2 * x::DOUBLE) / 2)), 4) AS total FROM embeddings")
def id2vec_average(spark, d):
    e = _table(spark, d, "embeddings").select(F.concat_ws(".", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("token"), F.col("embedding").cast("array<double>").alias("embedding"))
    twice = e.withColumn("embedding", F.transform("embedding", lambda x: 2 * x))
    made = matrices.embeddings_of(e, twice)
    return made.select("token", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT CAST(vec_id AS VARCHAR) AS token, label AS freq FROM embeddings ORDER BY label DESC, CAST(vec_id AS VARCHAR) DESC LIMIT 100")
def projector_top(spark, d):
    e = _table(spark, d, "embeddings")
    token = F.col("vec_id").cast("string").alias("token")
    return matrices.projected(e.select(token, "embedding"), e.select(token, F.col("label").alias("freq")), 100).select("token", "freq")


TOPICS = "topics AS (SELECT CAST(label AS VARCHAR) AS topic, vec_id AS token_id, 't' || vec_id AS token, round(embedding[1]::DOUBLE, 3) AS weight FROM embeddings)"


@query(f"WITH {TOPICS} SELECT * FROM (SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, token_id) AS INTEGER) AS place, token, weight FROM topics WHERE weight <> 0) WHERE place <= 20")
def topic_top_tokens(spark, d):
    e = _table(spark, d, "embeddings")
    topics = e.select(F.col("label").cast("string").alias("topic"), F.col("vec_id").alias("token_id"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("token"), F.round(F.get("embedding", F.lit(0)).cast("double"), 3).alias("weight"))
    return matrices.topic_tokens(topics, 20)


@query()
def lda_topics(spark, d):
    tf = frequencies.term_frequency(_line_bags(spark, d))
    words = frequencies.indexed(tf)
    return matrices.lda_topics(matrices.bow_rows(tf, words), words.count(), topics=5, rounds=5)


@query()
def embedding_factors(spark, d):
    return matrices.factorized(matrices.pmi_targets(_cooc(spark, d)), rank=8, rounds=3).select("token", F.size("embedding").alias("size"))


# evaluation


@query(f"""WITH {NAMES}, s AS (SELECT token, {SPLIT.format('token')} AS w FROM names), k AS (SELECT token, w, array_to_string(w, '') AS plain FROM s WHERE length(array_to_string(w, '')) BETWEEN 1 AND 40)
SELECT token, array_to_string(list_concat(list_transform(string_split(plain, ''), lambda c: CAST(ascii(c) - 96 AS VARCHAR)), list_transform(range(40 - length(plain)), lambda z: '0')), ' ') AS chars,
CAST(len(w) - 1 AS INTEGER) AS n_splits FROM k""")
def splitter_features(spark, d):
    names = _names(spark, d).withColumn("token_split", F.array_join(_plain(F.col("token")), " "))
    made = evaluation.splitter_features(names)
    return made.select("token", F.array_join(F.col("chars").cast("array<string>"), " ").alias("chars"), F.aggregate("flags", F.lit(0), lambda a, x: a + x).alias("n_splits"))


@query(f"""WITH {NAMES}, s AS (SELECT {SPLIT.format('token')} AS w FROM names), k AS (SELECT array_to_string(w, '') AS plain, flatten(list_transform(w, lambda x: list_concat([1], list_transform(range(1, length(x)), lambda i: 0)))) AS flags FROM s),
places AS (SELECT '^^^^^^' || plain || '$$$$$$' AS padded, flags, unnest(range(1, length(plain))) AS i FROM k WHERE plain <> ''),
kinds AS (SELECT 'around' AS kind, -w AS lo, 2 * w AS size FROM range(0, 4) AS r(w) UNION ALL SELECT 'before', -w, w FROM range(0, 7) AS r(w) UNION ALL SELECT 'from', 0, w FROM range(0, 7) AS r(w))
SELECT kind, substr(padded, i + 7 + lo, size) AS context, count(*) AS n, CAST(sum(flags[i + 1]) AS BIGINT) AS begins FROM places, kinds GROUP BY ALL""")
def splitter_contexts(spark, d):
    """What the trained splitter counts of names whose words are known."""
    return splitter.trained(_names(spark, d).withColumn("token_split", F.array_join(_plain(F.col("token")), " ")))[0]


@query("WITH s AS (SELECT sum(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.05 THEN 1.0 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END)::DOUBLE AS y FROM lineitem), m AS (SELECT tp / (p + 1e-8) AS a, tp / (y + 1e-8) AS b FROM s) SELECT round(a, 6) AS \"precision\", round(b, 6) AS recall, round(2 * a * b / (a + b + 1e-8), 6) AS f1 FROM m")
def splitter_metrics(spark, d):
    li = _table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("p"))
    return evaluation.precision_recall(li, "y", "p", 0.05).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH f AS (SELECT c_nationkey AS role FROM customer GROUP BY c_nationkey HAVING count(*) >= 10), n AS (SELECT c_mktsegment AS identifier, c_nationkey AS role, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT role FROM f) GROUP BY ALL)
SELECT identifier, role FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY n DESC, role) AS p FROM n) WHERE p = 1""")
def role_mode_filter(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_mktsegment").alias("identifier"), F.col("c_nationkey").alias("role"))
    return evaluation.common_roles(c, "identifier", "role")


@query()
def role_eval_ml(spark, d):
    return evaluation.role_quality(_table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"), "label"), "embedding", "label")


# flows and streams


IDS = f"{NODES}, s AS (SELECT document, node_id, ancestors, {SPLIT.format('token')} AS ws FROM nodes WHERE list_contains(roles, 'IDENTIFIER')), ids AS (SELECT document, node_id, ancestors, {PROCESSED.format(_merged('ws', 3))} AS words FROM s)"


@query(f"""WITH RECURSIVE {IDS}, {CHILDREN[len(NODES) + 2:]}, {GREEDY.format(20)}, graph AS (SELECT document, parent_id AS node_id, string_agg(internal_type, '_' ORDER BY internal_type) AS below FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL),
parts AS (SELECT 'i.' || word AS token, document FROM (SELECT unnest(words) AS word, document FROM ids)
 UNION ALL SELECT 'g.' || concat_ws('_', coalesce(p.internal_type, 'None'), n.internal_type, below), n.document FROM nodes n LEFT JOIN nodes p ON p.document = n.document AND p.node_id = n.parent_id LEFT JOIN graph ON graph.document = n.document AND graph.node_id = n.node_id
 UNION ALL SELECT 'c.' || internal_type || '_' || (len(list_filter(levels, lambda x: x <= n_children)) - 1), document FROM kids JOIN quant USING (internal_type)),
tf AS (SELECT token, document, count(*) AS value FROM parts GROUP BY ALL), df AS (SELECT token, count(*) AS freq FROM tf GROUP BY token HAVING count(*) >= 2)
SELECT document, CAST(count(*) AS INTEGER) AS n, round(sum(ln(1 + value) * ln((SELECT count(DISTINCT document) FROM tf)::DOUBLE / freq)), 4) AS total FROM tf JOIN df USING (token) GROUP BY document""")
def repos2bow(spark, d):
    found = flows.Features(_nodes(spark, d))
    made = flows.repos2bow(found.bags(["id", "graphlet", "children"]), least=2, found=found)
    return made.select("document", F.size("tokens").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"""WITH {IDS}, up AS (SELECT document, node_id, unnest(ancestors) AS up, generate_subscripts(ancestors, 1) AS d FROM ids), near AS (SELECT up.document, up.node_id, max_by(up.up, up.d) AS near FROM up JOIN ids i ON i.document = up.document AND i.node_id = up.up GROUP BY ALL),
ctx AS (SELECT document, node_id AS spot, words FROM ids UNION ALL SELECT i.document, coalesce(n.near, i.ancestors[1]), words FROM ids i LEFT JOIN near n ON n.document = i.document AND n.node_id = i.node_id WHERE coalesce(n.near, i.ancestors[1]) IS NOT NULL),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT token FROM (SELECT DISTINCT document, unnest(words) AS token FROM ids) GROUP BY token HAVING count(*) >= 2)),
n AS (SELECT document, spot, id, count(*) AS n FROM (SELECT document, spot, unnest(words) AS token FROM ctx) JOIN vocab USING (token) GROUP BY ALL)
SELECT a.id AS "row", b.id AS col, CAST(sum(a.n * (b.n - CASE WHEN a.id = b.id THEN 1 ELSE 0 END)) AS BIGINT) AS weight FROM n a JOIN n b USING (document, spot) GROUP BY ALL HAVING weight > 0""")
def repos2coocc(spark, d):
    return flows.repos2coocc(_nodes(spark, d), least=2)


@query("SELECT date_trunc('hour', ts) AS start, event_type AS token, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    """The batch twin of the streamed windows."""
    e = _table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("token")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "token", "n")
