"""Line dedup with a log-template tree.

As in fixed-depth log parsing, a line goes to a leaf by its number of tokens and its leading tokens, tokens with a digit being
variable fields from the start. Within a leaf, a token that many documents have at its place is constant and any other is
a variable field; the constants and fields of a line are its template. Templates that recur across documents are dropped.
Documents that consist mostly of recurring lines are copies of each other rather than pages with boilerplate: they do not
count as places where a template recurs, so copies stay whole for the deduplication of documents; with ``copies_once`` those
that are copies of each other count as one place, so that a passage of many short documents goes.
"""

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.components import components
from moneytrail.llm.helpers import fresh, hinted, let
from moneytrail.llm.simhash import shingle_set
from moneytrail.scratch import materialize, materialize_counted

#: Leading tokens that lead to a leaf; lines of so many tokens or fewer have a template only with ``short``.
DEPTH = 3
#: Documents that must share a token's place to make it constant, and a template to make it recur.
MIN_DOCS = 5
#: Share of constant tokens that a template needs.
CONSTANT = 0.7
#: Share of a document's words in recurring lines from which it does not count.
COPY = 0.5
#: Similarity of five-word shingles from which documents are copies of each other, and pairs of least hashes that find them.
ALIKE, BANDS = 0.8, 12
FIELD = "<*>"
_OTHER_SPACE = "\t\x0b\x0c\r"
_WORD_WITH_DIGIT = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+"


def tokens(line: Column) -> Column:
    """Tokens of a line whose only white space is spaces, none at its ends; one empty token for an empty line."""
    return F.split(line, " +")


def keyed(docs: DataFrame, key: str = "id_", code: str = "text_hash") -> DataFrame:
    """``docs`` with a key of its id and text that is never null; equal rows have equal keys."""
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).withColumn(code, F.xxhash64("text"))


def parsed(docs: DataFrame, depth: int, short: bool = False) -> DataFrame:
    """One row per line of more than ``depth`` tokens, with ``short`` per line that is not blank: id_, text_hash, n_words of the document, line_no, line (fields marked), n, leaf, whole."""
    spaced = F.translate("text", _OTHER_SPACE, " " * len(_OTHER_SPACE))
    masked = F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, _WORD_WITH_DIGIT, FIELD)).otherwise(spaced)
    each = F.transform(F.split(masked, "\n"), lambda line, i: let(F.trim(line), lambda t: F.struct(
        i.alias("line_no"), t.alias("line"), F.when(t != "", tokens(t)).otherwise(F.array().cast("array<string>")).alias("ws")
    )))
    return (
        docs.select("id_", "text_hash", each.alias("each"))
        .withColumn("n_words", F.aggregate("each", F.lit(0), lambda sum_, s: sum_ + F.size(s["ws"])))
        .select("id_", "text_hash", "n_words", F.explode(F.filter("each", lambda s: F.size(s["ws"]) > (0 if short else depth))).alias("s"))
        .select("id_", "text_hash", "n_words", "s.line_no", "s.line", F.size("s.ws").alias("n"), "s.ws", F.xxhash64(F.size("s.ws"), F.slice("s.ws", 1, depth)).alias("leaf"))
        .withColumn("whole", F.xxhash64("leaf", "ws")).drop("ws")
    )


def copy_groups(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(text_hash, place) of the ``chosen`` documents: equal for equal texts and for those that links of similar texts connect.

    Texts that agree in a pair of least hashes of their shingles are compared with the first of them, so links are linear.
    """
    texts = docs.join(chosen.select("id_", "text_hash").distinct(), ["id_", "text_hash"]).groupBy("text_hash").agg(F.min("text").alias("text"))
    sets = materialize(texts.select("text_hash", shingle_set(F.col("text"), 5).alias("set")).where(F.size("set") > 0), "copy-shingles")
    rng = random.Random(BANDS)
    least = [F.array_min(F.transform("set", lambda x, c=rng.getrandbits(63): x.bitwiseXOR(F.lit(c)))) for _ in range(2 * BANDS)]
    keys = F.array(*(F.xxhash64(F.lit(i), least[2 * i], least[2 * i + 1]) for i in range(BANDS)))
    found = sets.select("text_hash", F.explode(keys).alias("band"))
    first = found.groupBy("band").agg(F.min("text_hash").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = found.join(first, "band").where("text_hash <> first").select("text_hash", "first").distinct()
    both = links.join(sets, "text_hash").join(sets.select(F.col("text_hash").alias("first"), F.col("set").alias("other")), "first")
    shared = F.size(F.array_intersect("set", "other"))
    held = both.where(shared >= ALIKE * (F.size("set") + F.size("other") - shared)).select("text_hash", "first")
    groups = components(held, "text_hash", "first").withColumnRenamed("node", "text_hash")
    return sets.select("text_hash").join(groups, "text_hash", "left").select("text_hash", F.coalesce("parent", "text_hash").alias("place"))


def boilerplate(docs: DataFrame, depth: int, min_docs: int, constant: float, copy: float, short: bool = False, copies_once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines (id_, text_hash, line_no, whole) and the ``whole`` codes of those whose template recurs.

    ``docs`` is ``keyed``. Counting works on distinct (document, line) pairs, then on distinct lines, so a line in a third of
    all documents is one row from there on.
    """
    lines = materialize(parsed(docs, depth, short), "lines")
    held = lines.groupBy("id_", "text_hash", "leaf", "whole").agg(F.sum("n").alias("words"), F.first("n_words").alias("n_words"))
    counted = held.groupBy("leaf", "whole").agg(F.count("*").alias("docs"))
    # a leaf with fewer documents than min_docs holds no recurring template
    counted = materialize(counted, "distinct-lines")
    crowded, leaves = materialize_counted(
        counted.groupBy("leaf").agg(F.sum("docs").alias("sum")).where(F.col("sum") >= min_docs).select("leaf"), "crowded-leaves"
    )
    shown = lines.select("leaf", "whole", "line").join(hinted(crowded, leaves), "leaf").groupBy("leaf", "whole").agg(F.min("line").alias("line"))
    variants = materialize(shown.join(counted, ["leaf", "whole"]).select("leaf", "whole", "docs", tokens(F.col("line")).alias("ws")), "line-variants")

    # template of each distinct line: its token at each place, or a field
    at = variants.select("leaf", "whole", "docs", F.posexplode("ws").alias("place", "token"))
    fixed = at.where(F.col("token") != FIELD).groupBy("leaf", "place", "token").agg(F.sum("docs").alias("sum")).where(F.col("sum") >= min_docs).drop("sum")
    marked = at.join(fixed.withColumn("fixed", F.lit(1)), ["leaf", "place", "token"], "left")
    template = F.bit_xor(F.when(F.col("fixed") == 1, F.xxhash64("place", "token")).otherwise(F.xxhash64("place", F.lit(1))))
    templates = marked.groupBy("leaf", "whole").agg(
        template.alias("shape"), (F.count("fixed") / F.count("*")).alias("share")
    ).where(F.col("share") >= constant).select("whole", F.xxhash64("leaf", "shape").alias("template"))
    templates = materialize(templates, "templates")

    def recurring(rows: DataFrame) -> DataFrame:
        """Templates in ``min_docs`` different documents, as a stored table: a join with it can split a common template."""
        counted = rows.select("template", "id_", "text_hash").distinct().groupBy("template").agg(F.count("*").alias("docs"))
        return materialize(counted.where(F.col("docs") >= min_docs).select("template"), "recurring-templates")

    of_templates = materialize(held.join(templates, "whole").select("id_", "text_hash", "words", "n_words", "template"), "lines-of-templates")
    again = of_templates.join(recurring(of_templates), "template")
    covered = again.groupBy("id_", "text_hash").agg(F.sum("words").alias("covered"), F.first("n_words").alias("n_words"))
    own = F.col("covered") < copy * F.col("n_words")
    pages = covered.where(own).select("id_", "text_hash")
    if copies_once:
        covered = materialize(covered, "documents-with-recurring-lines")
        places = covered.where(own).select("id_", "text_hash", F.xxhash64("id_", "text_hash").alias("place"))
        copies = covered.where(~own).select("id_", "text_hash").join(copy_groups(docs, covered.where(~own)), "text_hash")
        places = again.join(places.unionByName(copies), ["id_", "text_hash"])
        counted = places.select("template", "place").distinct().groupBy("template").agg(F.count("*").alias("docs"))
        dropped = materialize(counted.where(F.col("docs") >= min_docs).select("template"), "recurring-templates")
    else:
        dropped = recurring(again.join(pages, ["id_", "text_hash"]))
    return lines, materialize(templates.join(dropped, "template").select("whole"), "boilerplate")


def drop_recurring(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT, copy: float = COPY, short: bool = False,
    copies_once: bool = False,
) -> tuple[DataFrame, str, str]:
    """``docs`` with the text freed of recurring lines, and the names of two added columns: its lines, and those dropped.

    Lines end at line feeds; the others stay as they are, in order. A text is null only if it was. Blank lines
    never go, and lines of ``depth`` tokens or fewer only with ``short``: all their tokens lead to their leaf. A document that consists of boilerplate is left with an empty text. Rows with the same
    doc_id and text count as one document. All other columns are kept.
    """
    key, code = fresh(docs, "id_"), fresh(docs, "text_hash")
    slim = keyed(docs.select("doc_id", "text"))
    lines, gone = boilerplate(slim, depth, min_docs, constant, copy, short, copies_once)
    out = lines.join(gone, "whole").groupBy("id_", "text_hash").agg(F.collect_set("line_no").alias("out"))
    n_lines, n_dropped, places = fresh(docs, "n_lines"), fresh(docs, "n_dropped"), fresh(docs, "out")
    joined = keyed(docs, key, code).join(out.select(F.col("id_").alias(key), F.col("text_hash").alias(code), F.col("out").alias(places)), [key, code], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(places, i)), "\n")
    return (
        joined.withColumn(n_lines, F.coalesce(F.size(F.split("text", "\n")), F.lit(0)))
        .withColumn(n_dropped, F.coalesce(F.size(places), F.lit(0)))
        .withColumn("text", F.when(F.col(places).isNotNull(), kept).otherwise(F.col("text")))
        .select(*docs.columns, n_lines, n_dropped), n_lines, n_dropped,
    )
