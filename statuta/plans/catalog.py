"""The query catalogue: one ``(spark, sf_dir) -> DataFrame`` per SURVEY §7.4 key.

Every query reads the driver tables (sometimes with literal probe rows appended)
and runs over whole tables.  Integer outputs are BIGINT and float outputs are
rounded to 6 decimals so the DuckDB oracle (``oracle.py``) can be compared value
by value.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.operators import articles as A
from statuta.operators import bm25
from statuta.operators import contain as C
from statuta.operators import frontier as FR
from statuta.operators import html as H
from statuta.operators import qa as QA
from statuta.operators import sink as SK
from statuta.operators import store as S
from statuta.operators.shred import shred
from statuta.plans import jobs as J
from statuta.plans import pagesets as PS
from statuta.plans.probes import probe_frame
from statuta.session import broadcast_if_small
from statuta.session import clustered
from statuta.session import evenly
from statuta.session import scratch_path
from statuta.session import spread
from statuta.sources import files as FS
from statuta.sources import snapshots as SN
from statuta.sources.tables import table
from statuta.streaming import bookmarks as SB
from statuta.streaming import ingest as ST

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------------------
# Inputs shared by several queries
# ---------------------------------------------------------------------------

def html_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), ["page_id"])
    return pages.unionByName(probe_frame(spark, "page_id", "html"))


def dirty_text_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document text with extra spaces and blank lines (same expression as the oracle)."""
    docs = documents(spark, sf_dir).select(
        "doc_id", F.replace("text", F.lit(" t"), F.lit("  \n t")).alias("text"))
    return docs.unionByName(probe_frame(spark, "doc_id", "text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), ["doc_id"])


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


# ---------------------------------------------------------------------------
# TX: cleaning rules
# ---------------------------------------------------------------------------

@register("strip_tags_plain")
def q_strip_tags_plain(spark, sf_dir):
    return html_input(spark, sf_dir).select("page_id", T.strip_tags("html").alias("out"))


@register("strip_tags_flat")
def q_strip_tags_flat(spark, sf_dir):
    return html_input(spark, sf_dir).select("page_id", T.strip_tags_flat("html").alias("out"))


@register("strip_tags_keep_newlines")
def q_strip_tags_keep_newlines(spark, sf_dir):
    return html_input(spark, sf_dir).select(
        "page_id", T.strip_tags_keep_newlines("html").alias("out"))


@register("strip_tags_multiline")
def q_strip_tags_multiline(spark, sf_dir):
    return html_input(spark, sf_dir).select(
        "page_id", T.strip_tags_multiline("html").alias("out"))


@register("delete_tag_block")
def q_delete_tag_block(spark, sf_dir):
    return html_input(spark, sf_dir).select(
        "page_id",
        T.delete_tag_block("html", "div").alias("div_default"),
        T.delete_tag_block("html", "div", compat=True).alias("div_compat"),
        T.delete_tag_block("html", "table").alias("table_default"),
        T.delete_tag_block("html", "table", compat=True).alias("table_compat"))


@register("normalize_whitespace")
def q_normalize_whitespace(spark, sf_dir):
    return dirty_text_input(spark, sf_dir).select(
        "doc_id",
        T.normalize_whitespace("text").alias("out_default"),
        T.normalize_whitespace("text", compat=True).alias("out_compat"))


@register("collapse_whitespace")
def q_collapse_whitespace(spark, sf_dir):
    return dirty_text_input(spark, sf_dir).select(
        "doc_id", T.collapse_whitespace("text").alias("out"))


DEFAULT_DOMAIN = "legal-portal"


@register("escape_columns")
def q_escape_columns(spark, sf_dir):
    """TX17/TX18 + PRJ2/PRJ3: the stored projection of a document."""
    return dirty_text_input(spark, sf_dir).join(
        documents(spark, sf_dir).select("doc_id", "lang", "source"), "doc_id", "left"
    ).select(
        "doc_id",
        T.escape_apostrophes("text").alias("content"),
        T.fold_case("source").alias("source"),
        T.escape_apostrophes(T.fold_case("lang")).alias("lang"),
        F.lit(DEFAULT_DOMAIN).alias("domain"))


# ---------------------------------------------------------------------------
# BM25
# ---------------------------------------------------------------------------

def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to be ranked: a document's postings lie in one partition, so that neither they nor
    the sums of (query, document) pairs are shuffled, only the texts, once."""
    return clustered(table(spark, sf_dir, "documents"), ["doc_id"])


def doc_index(spark, sf_dir) -> bm25.Bm25Index:
    return bm25.build_index(ranked_documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])


@register("term_frequency")
def q_term_frequency(spark, sf_dir):
    tf = bm25.term_frequencies(documents(spark, sf_dir), ["doc_id"], "text")
    return tf.select("doc_id", "token", F.col("tf").cast("bigint").alias("tf"),
                     F.col("dl").cast("bigint").alias("dl"))


@register("document_frequency")
def q_document_frequency(spark, sf_dir):
    idx = doc_index(spark, sf_dir)
    return idx.vocab.select("token", F.col("df").cast("bigint").alias("df"))


@register("bm25_idf")
def q_bm25_idf(spark, sf_dir):
    idx = doc_index(spark, sf_dir)
    return idx.vocab.select("token", F.round("idf", 6).alias("idf"))


@register("corpus_stats")
def q_corpus_stats(spark, sf_dir):
    idx = doc_index(spark, sf_dir)
    return idx.stats.select(
        F.col("n_docs").cast("bigint").alias("n_docs"),
        F.col("total_len").cast("bigint").alias("total_len"),
        F.round("avgdl", 6).alias("avgdl"),
        F.col("n_terms").cast("bigint").alias("n_terms"),
        F.round("mean_idf", 6).alias("mean_idf"),
        F.round("eps", 6).alias("eps"))


@register("bm25_top1")
def q_bm25_top1(spark, sf_dir):
    idx = doc_index(spark, sf_dir)
    return bm25.top1(idx, benchmark(spark, sf_dir), ["item_id"])


def sentence_corpus(spark, sf_dir) -> DataFrame:
    """TX14: one row per line of each document; corpus order is (doc_id, line_no)."""
    return ranked_documents(spark, sf_dir).select(
        "doc_id", F.posexplode(T.lines("text")).alias("line_no", "text")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


@register("bm25_top15")
def q_bm25_top15(spark, sf_dir):
    idx = bm25.build_index(sentence_corpus(spark, sf_dir), ["doc_id", "line_no"])
    return bm25.topk(idx, benchmark(spark, sf_dir), ["item_id"], 15).select(
        "item_id", "rank", "doc_id", "line_no", "score")


# ---------------------------------------------------------------------------
# Statute segmentation and article keys (driver-table statutes from lineitem)
# ---------------------------------------------------------------------------


def lineitem_statutes(spark, sf_dir) -> DataFrame:
    return A.statute_lines_from_lineitem(table(spark, sf_dir, "lineitem"))


@register("articles_reference")
def q_articles_reference(spark, sf_dir):
    return A.segment_articles(lineitem_statutes(spark, sf_dir), compat=True)


@register("articles_all")
def q_articles_all(spark, sf_dir):
    return A.segment_articles(lineitem_statutes(spark, sf_dir), compat=False)


def heading_lines(spark, sf_dir) -> DataFrame:
    """Heading-like strings from lineitem: valid, lower-case without dot, invalid."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("string")
    line = (F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Điều "), n, F.lit(". "), F.col("l_linestatus")))
            .when(F.col("l_returnflag") == "N", F.concat(F.lit("điều "), n))
            .otherwise(F.concat(F.lit("Điều "), n, F.lit("a. "), F.col("l_linestatus"))))
    return li.select("l_orderkey", line.alias("line"))


@register("article_number")
def q_article_number(spark, sf_dir):
    return heading_lines(spark, sf_dir).select(
        "line", T.article_number("line").alias("art_no"), T.heading_kind("line").alias("kind"))


@register("article_keys")
def q_article_keys(spark, sf_dir):
    h = heading_lines(spark, sf_dir)
    return h.where(T.heading_kind("line") == "article").select(
        "l_orderkey", T.law_key("l_orderkey", T.article_number("line")).alias("key"))


@register("gold_labels")
def q_gold_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("string")
    art = (F.when(F.col("l_returnflag") == "A", n)
           .when(F.col("l_returnflag") == "N",
                 F.concat(F.lit("Điều "), n, F.lit(", "), F.col("l_suppkey").cast("string")))
           .otherwise(F.concat(n, F.lit(".0"))))
    law = F.concat(F.col("l_orderkey").cast("string"), F.lit(". LUẬT"))
    x = li.select(law.alias("law"), art.alias("art"))
    return x.select(
        "law", "art",
        F.array_join(T.gold_keys("law", "art"), "|").alias("gold_default"),
        F.array_join(T.gold_keys("law", "art", compat=True), "|").alias("gold_compat"),
        F.size(T.gold_keys("law", "art")).cast("bigint").alias("n_gold"))


# ---------------------------------------------------------------------------
# Questions from benchmark passages, containment, votes, accuracy, dataset
# ---------------------------------------------------------------------------


def benchmark_questions(spark, sf_dir) -> DataFrame:
    """Each passage becomes a question (first half of its words) with four choices
    cut from the second half; empty cuts are missing choices."""
    b = benchmark(spark, sf_dir)
    w = T.tokens("text")
    n = F.size(w)
    h = F.ceil(n / 2).cast("int")
    rest = F.slice(w, h + 1, n - h)
    c = F.ceil((n - h) / 4).cast("int")

    def cut(i):
        part = F.slice(rest, c * i + 1, c)
        return F.when(F.size(part) > 0, F.array_join(part, " "))

    return b.select("item_id", "text",
                    F.array_join(F.slice(w, 1, h), " ").alias("quest"),
                    *[cut(i).alias(letter) for i, letter in enumerate(QA.CHOICE_LETTERS)])


@register("choices_expanded")
def q_choices_expanded(spark, sf_dir):
    return QA.expand_choices(benchmark_questions(spark, sf_dir), ["item_id"])


def all_forms(spark, sf_dir) -> DataFrame:
    """True/false form (choice_no 0, the whole passage) and the four choice forms."""
    bq = benchmark_questions(spark, sf_dir)
    tf = bq.select("item_id", F.lit(0).cast("bigint").alias("choice_no"), "text")
    mc = QA.expand_choices(bq, ["item_id"]).select("item_id", "choice_no", "text")
    return tf.unionByName(mc)


def form_predictions(spark, sf_dir, idx) -> DataFrame:
    from pyspark import StorageLevel

    return bm25.top1(idx, all_forms(spark, sf_dir), ["item_id", "choice_no"]).persist(
        StorageLevel.MEMORY_AND_DISK)


def choice_vote(preds: DataFrame, items: DataFrame) -> DataFrame:
    v = QA.vote(preds.where(F.col("choice_no") > 0), ["item_id"], ["doc_id"])
    return items.join(v, "item_id", "left").select(
        "item_id", "doc_id", F.coalesce(F.col("votes"), F.lit(0)).cast("bigint").alias("votes"))


@register("bm25_choice_vote")
def q_bm25_choice_vote(spark, sf_dir):
    idx = doc_index(spark, sf_dir)
    forms = all_forms(spark, sf_dir).where(F.col("choice_no") > 0)
    preds = bm25.top1(idx, forms, ["item_id", "choice_no"])
    return choice_vote(preds, benchmark(spark, sf_dir).select("item_id"))


def passage_pairs(spark, sf_dir, idx: bm25.Bm25Index | None = None) -> DataFrame:
    return C.containment_pairs(benchmark(spark, sf_dir), ["item_id"], documents(spark, sf_dir), "doc_id",
                               dtokens=idx.tf if idx else None, dfreq=idx.vocab if idx else None)


@register("passage_containment")
def q_passage_containment(spark, sf_dir):
    return passage_pairs(spark, sf_dir)


@register("sentence_hits")
def q_sentence_hits(spark, sf_dir):
    """AGG7: top-15 sentences per passage, articles containing them, most hits wins
    (ties: first hit in rank order, then corpus order)."""
    sents = sentence_corpus(spark, sf_dir)
    idx = bm25.build_index(sents, ["doc_id", "line_no"])
    top = bm25.topk(idx, benchmark(spark, sf_dir), ["item_id"], 15).select(
        "item_id", "rank", "doc_id", "line_no")
    top, _ = broadcast_if_small(top, 10_000_000, persist=True)
    top_text = sents.join(top, ["doc_id", "line_no"]).select("item_id", "rank", "text")
    hits = C.containment_pairs(top_text, ["item_id", "rank"], documents(spark, sf_dir), "doc_id")
    tally = hits.groupBy("item_id", "doc_id").agg(
        F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_rank"))
    win = tally.groupBy("item_id").agg(F.min_by(
        F.struct("doc_id", "hits"),
        F.struct(-F.col("hits"), F.col("first_rank"), F.col("doc_id"))).alias("w"))
    return benchmark(spark, sf_dir).select("item_id").join(
        win.select("item_id", "w.doc_id", "w.hits"), "item_id", "left").select(
        "item_id", "doc_id", F.coalesce(F.col("hits"), F.lit(0)).cast("bigint").alias("hits"))


def judged_predictions(spark, sf_dir) -> DataFrame:
    """SET4 + JN6: true/false predictions followed by multiple-choice ones, judged
    against the documents that contain the passage."""
    idx = doc_index(spark, sf_dir)
    preds = form_predictions(spark, sf_dir, idx)
    items = benchmark(spark, sf_dir).select("item_id")
    tf = preds.where(F.col("choice_no") == 0).select(
        F.lit("tf").alias("kind"), "item_id", F.col("doc_id").alias("pred"))
    mc = choice_vote(preds, items).select(
        F.lit("mc").alias("kind"), "item_id", F.col("doc_id").alias("pred"))
    gold = passage_pairs(spark, sf_dir, idx).persist()
    return QA.judge(tf.unionByName(mc), gold, ["item_id"], "pred", "doc_id"), gold


@register("retrieval_accuracy")
def q_retrieval_accuracy(spark, sf_dir):
    judged, _ = judged_predictions(spark, sf_dir)
    # one pass: the roll-up's total row is the row of all kinds
    return QA.accuracy(judged, ["kind"], total="all")


@register("retrieval_accuracy_by_source")
def q_retrieval_accuracy_by_source(spark, sf_dir):
    judged, gold = judged_predictions(spark, sf_dir)
    first_gold = gold.groupBy("item_id").agg(F.min("doc_id").alias("gold_doc"))
    src = first_gold.join(documents(spark, sf_dir).select(
        F.col("doc_id").alias("gold_doc"), "source"), "gold_doc").select("item_id", "source")
    return QA.accuracy(judged.join(src, "item_id", "left"), ["source"])


@register("training_set")
def q_training_set(spark, sf_dir):
    """DS1 + JN2: one row per (question, gold article) with type, choices, answer, the
    article's text and its labels; questions without a gold article keep one row with NULLs."""
    gold = passage_pairs(spark, sf_dir)
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("article"))
    labels = table(spark, sf_dir, "labels")
    arts = gold.join(docs, "doc_id").join(labels, "doc_id", "left")
    kind = F.when(F.col("D").isNotNull(), T.MULTIPLE_CHOICE_TYPE).otherwise("Đúng/Sai")
    return benchmark_questions(spark, sf_dir).select(
        "item_id", kind.alias("question_type"), "quest", *QA.CHOICE_LETTERS, F.col("A").alias("answer")).join(
        arts, "item_id", "left").select(
        "item_id", "question_type", "quest", *QA.CHOICE_LETTERS, "answer", "doc_id", "article",
        F.col("quality").cast("bigint").alias("quality"),
        F.col("toxic").cast("bigint").alias("toxic"))


# ---------------------------------------------------------------------------
# Store, bookmarks, frontier
# ---------------------------------------------------------------------------


def two_batches(df: DataFrame, batch_col: F.Column) -> tuple[DataFrame, DataFrame]:
    x = df.withColumn("batch", batch_col.cast("bigint"))
    return x.where(F.col("batch") == 1), x.where(F.col("batch") == 2)


@register("insert_if_absent_text")
def q_insert_if_absent_text(spark, sf_dir):
    """MUT1/SNK2: documents arrive in two batches (English first); a text already
    stored is not stored again; first by doc_id wins inside a batch.  Texts are keyed by
    their digest, so they are not shuffled."""
    docs = documents(spark, sf_dir).select("doc_id", S.key_digest(["text"]).alias("text_key"), "lang", "n_chars")
    b1, b2 = two_batches(docs, F.when(F.col("lang") == "en", 1).otherwise(2))
    sink = S.first_per_key(b1, ["text_key"], ["doc_id"])
    final = S.insert_if_absent(sink, b2, ["text_key"], ["doc_id"])
    return final.select("doc_id", "batch", "lang", "n_chars")


def doc_links(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("link"),
                       "n_chars")


@register("insert_if_absent_link")
def q_insert_if_absent_link(spark, sf_dir):
    """MUT2: key = link; short documents arrive first."""
    b1, b2 = two_batches(doc_links(spark, sf_dir),
                         F.when(F.col("n_chars") < 2000, 1).otherwise(2))
    sink = S.first_per_key(b1, ["link"], ["doc_id"])
    return S.insert_if_absent(sink, b2, ["link"], ["doc_id"]).select("link", "doc_id", "batch")


@register("seen_links")
def q_seen_links(spark, sf_dir):
    return S.seen(documents(spark, sf_dir).select("doc_id", "source"),
                  table(spark, sf_dir, "labels"), ["doc_id"])


@register("unseen_links")
def q_unseen_links(spark, sf_dir):
    return S.unseen(documents(spark, sf_dir).select("doc_id", "source"),
                    table(spark, sf_dir, "labels"), ["doc_id"])


def event_links(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", "user_id", "event_type",
                     F.concat(F.lit("/p/"), F.floor("value").cast("string")).alias("link"))


@register("visited_append")
def q_visited_append(spark, sf_dir):
    """MUT3: every view appends its link, no check (duplicates stay)."""
    return event_links(spark, sf_dir).where(F.col("event_type") == "view").select(
        "user_id", "link", "event_id")


@register("bookmark_latest")
def q_bookmark_latest(spark, sf_dir):
    """MUT4/MUT5: per crawler (user) the bookmark is the latest link by (ts, event_id)."""
    return S.latest(event_links(spark, sf_dir), ["user_id"], ["link"], ["ts", "event_id"])


@register("bookmark_cleared")
def q_bookmark_cleared(spark, sf_dir):
    """MUT6: an 'error' event clears the bookmark; the last operation decides."""
    ops = event_links(spark, sf_dir).withColumn(
        "op", F.when(F.col("event_type") == "error", "clear").otherwise("set"))
    return S.apply_bookmark_ops(ops, ["user_id"], "op", "link", ["ts", "event_id"])


def supply_edges(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return li.select(s.alias("src"), p.alias("dst")).unionByName(li.select(p.alias("src"), s.alias("dst")))


def supply_seed(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.agg(F.concat(F.lit("s"), F.min("l_suppkey").cast("string")).alias("node"))


@register("frontier_round")
def q_frontier_round(spark, sf_dir):
    out = FR.bfs_rounds(spark, supply_edges(spark, sf_dir), supply_seed(spark, sf_dir), symmetric=True)
    return out.select("node", F.col("round").cast("bigint").alias("round"))


@register("frontier_reach")
def q_frontier_reach(spark, sf_dir):
    out = FR.bfs_rounds(spark, supply_edges(spark, sf_dir), supply_seed(spark, sf_dir), symmetric=True)
    return out.groupBy(F.col("round").cast("bigint").alias("round")).agg(
        F.count(F.lit(1)).alias("n_new"))


# ---------------------------------------------------------------------------
# Lookups, question filters, lines, seeds, quarantine
# ---------------------------------------------------------------------------

DIM_BROADCAST_ROWS = 1_000_000


@register("law_lookup")
def q_law_lookup(spark, sf_dir):
    """JN1: case-folded name -> 1-based id; unknown names are marked, not raised."""
    nation = table(spark, sf_dir, "nation")
    dim = nation.select(T.fold_case("n_name").alias("name_key"),
                        (F.col("n_nationkey") + 1).cast("bigint").alias("law_id"))
    dim, _ = broadcast_if_small(dim, DIM_BROADCAST_ROWS)
    names, _ = broadcast_if_small(nation.select("n_nationkey", "n_name"), DIM_BROADCAST_ROWS)
    cust = table(spark, sf_dir, "customer").join(
        names, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    fact = cust.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("n_name"))
                       .otherwise(F.col("c_mktsegment")).alias("name"))
    out = fact.join(dim, T.fold_case("name") == F.col("name_key"), "left")
    return out.select("c_custkey", "name", "law_id",
                      F.when(F.col("law_id").isNull(), "unknown").otherwise("ok").alias("status"))


def conversation_questions(spark, sf_dir) -> DataFrame:
    """CSV-like question rows from conversations: a user turn is a question; the
    next assistant turn with at least four lines makes it multiple choice (its
    first four lines are the choices), otherwise true/false; no assistant reply
    -> no format (dropped by FLT1).  The first turn has no article (NaN)."""
    from pyspark.sql import Window

    conv = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = (conv.withColumn("next_role", F.lead("role").over(w))
         .withColumn("next_text", F.lead("text").over(w))
         .where(F.col("role") == "user"))
    reply = T.lines("next_text")
    fmt = (F.when((F.col("next_role") == "assistant") & (F.size(reply) >= 4), F.lit(T.MULTIPLE_CHOICE_TYPE))
           .when(F.col("next_role") == "assistant", F.lit("Đúng/Sai")))
    return x.select(
        "conv_id", "turn", fmt.alias("format"),
        F.concat(F.col("conv_id").cast("string"), F.lit(". LUẬT")).alias("law"),
        F.when(F.col("turn") > 0, F.concat(F.col("turn").cast("string"), F.lit(".0"))).alias("art"),
        F.col("text").alias("quest"),
        *[F.get(reply, i).alias(c) for i, c in enumerate(QA.CHOICE_LETTERS)])


@register("qa_filter")
def q_qa_filter(spark, sf_dir):
    """FLT1 + FLT2: keep rows with a format, a question and an article; whole
    floats become ints."""
    q = conversation_questions(spark, sf_dir)
    return (q.where(F.col("format").isNotNull())
            .where(F.col("quest").isNotNull() & F.col("art").isNotNull())
            .select("conv_id", "turn", "format", "law", T.whole_float_to_int("art").alias("art"), "quest"))


@register("qa_kind_split")
def q_qa_kind_split(spark, sf_dir):
    """FLT3 + PRJ4/PRJ5: multiple choice vs everything else, with the projection
    (quest, A, B, C, D) for multiple choice and the gold keys."""
    q = conversation_questions(spark, sf_dir).where(F.col("format").isNotNull()).where(
        F.col("quest").isNotNull() & F.col("art").isNotNull())
    mc = F.col("format") == T.MULTIPLE_CHOICE_TYPE
    return q.select(
        "conv_id", "turn", F.when(mc, "mc").otherwise("tf").alias("kind"),
        F.array_join(T.gold_keys("law", "art"), "|").alias("gold"),
        *[F.when(mc, F.col(c)).alias(c) for c in QA.CHOICE_LETTERS])


@register("text_lines")
def q_text_lines(spark, sf_dir):
    """SRC2/TX14: lines with their number and token count."""
    s = sentence_corpus(spark, sf_dir)
    return s.select("doc_id", "line_no", F.col("text").alias("line"),
                    F.size(T.tokens("text")).cast("bigint").alias("n_tokens"))


SEED_BASE = "https://legal.example/search?page="
SEED_START = 4000


@register("seed_urls")
def q_seed_urls(spark, sf_dir):
    """SRC5: result-page URLs numbered from 4000, one per landed page."""
    pages = table(spark, sf_dir, "pages")
    no = (F.col("page_id") + SEED_START).cast("bigint")
    return pages.select(no.alias("page_no"), F.concat(F.lit(SEED_BASE), no.cast("string")).alias("url"))


@register("quarantine_split")
def q_quarantine_split(spark, sf_dir):
    """ST5: the first token of each line must be an integer; failures are kept in
    a quarantine status instead of raising."""
    s = dirty_text_input(spark, sf_dir).select(
        "doc_id", F.posexplode(T.lines("text")).alias("line_no", "line"))
    tok = F.get(T.tokens("line"), 0)
    val = tok.try_cast("bigint")
    return s.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), tok.alias("token"),
                    val.alias("value"),
                    F.when(val.isNull(), "quarantine").otherwise("ok").alias("status"))


# ---------------------------------------------------------------------------
# Page links and paragraphs (on the shredded relation of the landed pages)
# ---------------------------------------------------------------------------
LINK_BASE = "https://legal.example/page/"


def landed_pages(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id"])


def page_hrefs(pages: DataFrame) -> DataFrame:
    """Links of every page in document order, and whether they stand inside a ``nav``."""
    from pyspark.sql import Window

    a = shred(pages).where((F.col("tag") == "a") & F.col("href").isNotNull())
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("seq")) - 1
    return a.select("page_id", pos.cast("bigint").alias("pos"), "href",
                    F.col("path").rlike(r"(^|/)nav([#.][^/]*)?/").alias("in_nav"))


@register("page_links")
def q_page_links(spark, sf_dir):
    return page_hrefs(landed_pages(spark, sf_dir)).select("page_id", "pos", "href")


@register("page_links_absolute")
def q_page_links_absolute(spark, sf_dir):
    """XT10: plain prefixing, not URL resolution."""
    return q_page_links(spark, sf_dir).select(
        "page_id", "pos", F.concat(F.lit(LINK_BASE), F.col("href")).alias("url"))


@register("page_links_union")
def q_page_links_union(spark, sf_dir):
    """XT9 + SET1 + AGG12: the links of all navigation blocks followed by those of the
    rest of the page (duplicates kept), then made distinct."""
    from pyspark import StorageLevel

    a = page_hrefs(landed_pages(spark, sf_dir)).persist(StorageLevel.MEMORY_AND_DISK)
    return a.where("in_nav").select("href").unionAll(a.where("NOT in_nav").select("href")).distinct()


def merged_paragraphs(pages: DataFrame) -> DataFrame:
    p = shred(pages).where(F.col("tag") == "p")
    per_page = p.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p"))
    return pages.select("page_id").join(per_page, "page_id", "left").select(
        "page_id", F.coalesce(F.array_join(F.transform("p", lambda x: T.strip_tags(x["text"])), " "), F.lit(""))
        .alias("content"), F.coalesce(F.size("p"), F.lit(0)).cast("bigint").alias("n_paragraphs"))


@register("paragraphs_merged")
def q_paragraphs_merged(spark, sf_dir):
    """XT5: text of each paragraph of a page, joined by one space."""
    return merged_paragraphs(landed_pages(spark, sf_dir))


# ---------------------------------------------------------------------------
# HTML: extraction over the landed pages and pages composed in each layout
# ---------------------------------------------------------------------------


def with_landed(spark, sf_dir, *composed: DataFrame) -> DataFrame:
    """The given pages and composed ones, landed as one table in the shared folder."""
    # parsing pages of few bytes is the work; composed pages come spread
    pages = evenly(landed_pages(spark, sf_dir), ["page_id"])
    for more in composed:
        pages = pages.unionByName(more)
    path = scratch_path(spark, "landed-pages")
    pages.write.parquet(path)
    return spark.read.schema(pages.schema).parquet(path)


def document_pages(spark, sf_dir) -> DataFrame:
    return with_landed(spark, sf_dir, PS.document_pages(spark, sf_dir))


@register("element_counts")
def q_element_counts(spark, sf_dir):
    """XT0: start tags per page and tag, counted on the shredded relation."""
    el = shred(landed_pages(spark, sf_dir))
    return el.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@register("doc_header_fields")
def q_doc_header_fields(spark, sf_dir):
    return H.by_page(document_pages(spark, sf_dir).select("page_id", "html"), lambda once: H.with_fields(
        H.document_elements(once, H.TABLE_TAGS, H.LEAST_COLUMNS, html=False)).select("page_id", *H.FIELDS, "n_tables", "status"), H.header_fields)


@register("doc_tables")
def q_doc_tables(spark, sf_dir):
    return H.by_page(document_pages(spark, sf_dir).select("page_id", "html"), lambda once: H.with_tables(
        H.document_elements(once, H.TABLE_TAGS, H.LEAST_COLUMNS, html=False)).select("page_id", "appendix", "n_appendix_tables", "status"), H.appendix_tables)


@register("doc_content_appendix")
def q_doc_content_appendix(spark, sf_dir):
    return H.by_page(document_pages(spark, sf_dir).select("page_id", "html"), lambda once: H.with_split(
        H.document_elements(once)).select("page_id", "content", "appendix", "n_entries", "status"),
        H.content_and_appendix)


@register("doc_paragraph_fallback")
def q_doc_paragraph_fallback(spark, sf_dir):
    p = H.by_page(
        document_pages(spark, sf_dir).select("page_id", "html"),
        lambda once: H.with_paragraphs(H.document_elements(once, H.PARAGRAPH_TAGS, H.LEAST_COLUMNS, html=False)).select(
            "page_id", "level", F.coalesce("content", F.lit("")).alias("content")),
        lambda el, again: H.paragraphs(el, pages=again))
    return p.select("page_id", F.col("level").cast("bigint").alias("level"), "content")


@register("main_text")
def q_main_text(spark, sf_dir):
    pages = with_landed(spark, sf_dir, PS.statute_pages(spark, sf_dir)).select("page_id", "html")
    return H.by_page(pages, H.page_main_text, H.main_text)


@register("document_links")
def q_document_links(spark, sf_dir):
    pages = with_landed(spark, sf_dir, PS.result_pages(spark, sf_dir)).select("page_id", "html")
    return H.by_page(pages, H.page_document_links, lambda el, _: H.document_links(el)).select(
        "page_id", F.col("block").cast("bigint").alias("block"), "href")


@register("pager_links")
def q_pager_links(spark, sf_dir):
    pages = with_landed(spark, sf_dir, PS.result_pages(spark, sf_dir))
    return H.pager_links(shred(pages, tags=frozenset({"a"})), LINK_BASE).select("page_id", "url")


# ---------------------------------------------------------------------------
# Streaming ingest (files land in the shared folder; the sink is read back)
# ---------------------------------------------------------------------------


def _doc_batches(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "n_chars")
    return two_batches(docs, F.when(F.col("lang") == "en", 1).otherwise(2))


@register("stream_insert_if_absent")
def q_stream_insert_if_absent(spark, sf_dir):
    """ST1 + ST3: both batches land, one availableNow run stores each text once."""
    base = scratch_path(spark, "stream_ingest")
    b1, b2 = _doc_batches(spark, sf_dir)
    ST.land(b1, f"{base}/landing")
    ST.land(b2, f"{base}/landing")
    ST.insert_if_absent_stream(spark, f"{base}/landing", b1.schema, f"{base}/sink",
                               f"{base}/checkpoint", ["text"], ["batch", "doc_id"])
    return SK.read_rows(spark, f"{base}/sink", b1.schema).select("doc_id", "batch", "lang", "n_chars")


@register("stream_resume")
def q_stream_resume(spark, sf_dir):
    """ST2: run, land more, run again on the same checkpoint, then replay the second
    batch under a fresh checkpoint -- the sink holds each text once."""
    base = scratch_path(spark, "stream_resume")
    b1, b2 = _doc_batches(spark, sf_dir)
    args = (b1.schema, f"{base}/sink")
    ST.land(b1, f"{base}/landing")
    ST.insert_if_absent_stream(spark, f"{base}/landing", *args, f"{base}/checkpoint", ["text"], ["batch", "doc_id"])
    ST.land(b2, f"{base}/landing")
    ST.insert_if_absent_stream(spark, f"{base}/landing", *args, f"{base}/checkpoint", ["text"], ["batch", "doc_id"])
    ST.land(b2, f"{base}/replay")
    ST.insert_if_absent_stream(spark, f"{base}/replay", *args, f"{base}/checkpoint2", ["text"], ["batch", "doc_id"])
    return SK.read_rows(spark, f"{base}/sink", b1.schema).select("doc_id", "batch", "lang", "n_chars")


@register("bookmark_stream")
def q_bookmark_stream(spark, sf_dir):
    """MUT4-MUT6 as a stateful stream: the events land in two batches, the later ones of a
    crawler partly first; the last changes are the bookmarks."""
    base = scratch_path(spark, "bookmark_stream")
    events = event_links(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("crawler"),
        F.when(F.col("event_type") == "error", "clear").otherwise("set").alias("op"), "link",
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("seq"))
    for part in (0, 1):
        ST.land(events.where(F.pmod(F.xxhash64("seq"), F.lit(2)) == part), f"{base}/landing")
        SB.run_bookmarks(spark, f"{base}/landing", f"{base}/log", f"{base}/checkpoint")
    out = SB.bookmarks(spark, f"{base}/log")
    return out.select(F.col("crawler").cast("bigint").alias("user_id"), "link")


# ---------------------------------------------------------------------------
# End-to-end jobs over driver-derived files
# ---------------------------------------------------------------------------


def _statute_files(spark, sf_dir, base) -> DataFrame:
    """SNK1 -> SRC2 round trip: lineitem statutes as text files, read back by line."""
    laws = A.statute_texts_from_lineitem(table(spark, sf_dir, "lineitem"))
    # parquet of whole texts (one text file per law would be one file per order here)
    laws.select("law_id", F.array_join("raws", "\n").alias("text")) \
        .write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/statutes")
    texts = clustered(spark.read.parquet(f"{base}/statutes"), ["law_id"], STATUTE_BYTES)
    return A.statute_lines_from_text(texts)


#: Compressed bytes of statutes that one task splits into lines and articles.
STATUTE_BYTES = 2 << 20
#: Questions are written as text, of which most is repeated.
PACKED = {"compression": "gzip"}


def _lineitem_questions(li: DataFrame) -> DataFrame:
    """A question per line; its words, and each choice's, are dated lines of articles."""
    n = F.col("l_linenumber").cast("string")
    day = F.col("l_shipdate").cast("date")

    def dated(days: int):
        # tokens split on spaces only, so "status\ndate" is a token of the article text
        return F.concat(F.col("l_linestatus"), F.lit("\n"), F.date_add(day, days).cast("string"))

    def choice(days: int):
        return F.concat(F.lit("là "), dated(days))

    return li.select(
        F.col("l_returnflag").alias("part"),
        F.lit(None).cast("string").alias("STT"),
        F.when(F.col("l_linestatus") == "O", F.lit(T.MULTIPLE_CHOICE_TYPE)).otherwise(F.lit("Đúng/Sai")).alias("format"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit(". LUẬT")).alias("law"),
        F.when(F.col("l_returnflag") == "A", F.concat(n, F.lit(".0"))).otherwise(n).alias("art"),
        F.lit(None).cast("string").alias("art_cont"),
        F.concat(dated(0), F.lit(" ?")).alias("quest"),
        F.lit(None).cast("string").alias("anws"),
        choice(1).alias("A"), choice(0).alias("B"), choice(2).alias("C"), F.lit(None).cast("string").alias("D"),
        F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("comment"))


@register("eval_csv")
def q_eval_csv(spark, sf_dir):
    """DS3 + SRC3: one CSV file of questions per return flag, statutes from lineitem."""
    base = scratch_path(spark, "eval_csv")
    lines = _statute_files(spark, sf_dir, base)
    q = _lineitem_questions(table(spark, sf_dir, "lineitem"))
    (q.write.mode("overwrite").partitionBy("part")
     .option("header", True).options(**PACKED).csv(f"{base}/questions"))
    # a folder's files are one question set
    part = F.regexp_extract("file", r"part=([^/]+)/", 1)
    return J.eval_csv(spark, lines, f"{base}/questions", part).withColumnRenamed("file", "part")


def _json_questions(li: DataFrame) -> DataFrame:
    """The questions of lines as JSON rows that name their statute by title."""
    q = _lineitem_questions(li)
    # line 6 repeats its label, line 5 adds one of an unknown law: neither can be right
    own = F.struct(T.whole_float_to_int("art").alias("article_id"),
                   F.concat(F.lit("luật  "), F.split_part("law", F.lit("."), F.lit(1))).alias("law_id"))
    no = T.whole_float_to_int("art")
    more = F.when(no == "6", F.array(own)).when(no == "5", F.array(F.struct(
        F.lit("1").alias("article_id"), F.lit("luật nào").alias("law_id")))).otherwise(F.array().cast(
            "array<struct<article_id:string,law_id:string>>"))
    return q.select(
        F.concat_ws("-", F.split_part("law", F.lit("."), F.lit(1)), no, F.col("quest")).alias("quest_id"),
        F.col("format").alias("question_type"), F.col("quest").alias("text"),
        F.concat(F.array(own), more).alias("relevant_articles"), F.lit("B").alias("answer"),
        F.struct(*[F.col(c) for c in QA.CHOICE_LETTERS]).alias("choices"))


@register("eval_json")
def q_eval_json(spark, sf_dir):
    """DS4 + SRC4 + JN1: JSON questions naming their statute by title."""
    base = scratch_path(spark, "eval_json")
    lines = _statute_files(spark, sf_dir, base)
    # equal values give equal questions: only values are shuffled, and no texts
    asked = ["l_orderkey", "l_linenumber", "l_linestatus", "l_shipdate"]
    whole = F.greatest(*[F.col(c).isNull().cast("int") for c in asked]) == 0
    li = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date")) \
        .select(*asked, F.lit("N").alias("l_returnflag"))
    js = _json_questions(evenly(li.where(whole), asked).dropDuplicates(asked)).unionByName(
        _json_questions(li.where(~whole)).dropDuplicates(["quest_id"]))
    js.write.mode("overwrite").options(**PACKED).json(f"{base}/questions")
    names = lines.where(F.col("line_no") == 0).select(
        "law_id", F.col("raw").alias("name"), F.lower("raw").alias("name_key"))
    return J.eval_json(spark, lines, f"{base}/questions", names=names, multiline=False,
                       unknown_path=f"{base}/unknown").drop("all")


@register("statute_text")
def q_statute_text(spark, sf_dir):
    """DS5 + SNK1 + SRC2: statute pages -> cleaned text files -> lines -> articles."""
    base = scratch_path(spark, "statute_text")
    J.statute_text(with_landed(spark, sf_dir, PS.statute_pages(spark, sf_dir)), out_dir=f"{base}/text")
    return A.segment_articles(FS.read_statute_text(spark, f"{base}/text", keep=True), again=True)


@register("pages_to_documents")
def q_pages_to_documents(spark, sf_dir):
    """DS6: store the documents linked from result pages; a second run adds nothing."""
    base = scratch_path(spark, "doc_store")
    pages = with_landed(spark, sf_dir, PS.document_pages(spark, sf_dir), PS.result_pages(spark, sf_dir))
    J.pages_to_documents(spark, pages, f"{base}/store", DEFAULT_DOMAIN)
    J.pages_to_documents(spark, pages, f"{base}/store", DEFAULT_DOMAIN)
    return SK.read_rows(spark, f"{base}/store", J.DOC_STORE_SCHEMA)


@register("documents_with_appendix")
def q_documents_with_appendix(spark, sf_dir):
    """The document store with appendix, keyed by document number; a second run adds nothing."""
    base = scratch_path(spark, "doc_appendix")
    pages = document_pages(spark, sf_dir)
    J.documents_with_appendix(spark, pages, f"{base}/store", DEFAULT_DOMAIN)
    J.documents_with_appendix(spark, pages, f"{base}/store", DEFAULT_DOMAIN)
    return SK.read_rows(spark, f"{base}/store", J.DOC_APPENDIX_SCHEMA)


@register("snapshot_changes")
def q_snapshot_changes(spark, sf_dir):
    """SRC1 + SRC6: three landings of the given pages; what the last changed against the first."""
    base = scratch_path(spark, "snapshots")
    pages = table(spark, sf_dir, "pages")
    SN.land(spark, pages, base)
    SN.land(spark, pages.where("page_id % 3 <> 0"), base)
    third = pages.where("page_id % 7 <> 0").withColumn(
        "html", F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("<p>v3</p>"))).otherwise(F.col("html")))
    new = pages.where("page_id % 11 = 0").withColumn("url", F.concat("url", F.lit("#new")))
    SN.land(spark, third.unionByName(new), base)
    return SN.changes(spark, base, 1, 3).select("url", "change")


@register("landed_files")
def q_landed_files(spark, sf_dir):
    """SRC1: pages landed as one file each, read back as a snapshot with its own page numbers."""
    base = scratch_path(spark, "landed_files")
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    pages.select(name.alias("name"), F.regexp_replace("html", "\n", " ").alias("value")) \
        .repartition("name").write.partitionBy("name").option("lineSep", "\n") \
        .options(**FS.TASKS_COMMIT).text(f"{base}/files")
    SN.land(spark, FS.read_pages_from_files(spark, f"{base}/files"), f"{base}/snapshots")
    got = SN.read(spark, f"{base}/snapshots")
    text = F.regexp_replace("html", "\n$", "")
    return got.select(F.regexp_extract("url", r"name=(\d+)\.html", 1).cast("bigint").alias("page_id"),
                      F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("digest"))


@register("url_list_statutes")
def q_url_list_statutes(spark, sf_dir):
    """SRC6 + DS5: the listed statute URLs, every second of those landed, as texts by their place."""
    pages = with_landed(spark, sf_dir, PS.statute_pages(spark, sf_dir))
    listed = PS.statute_pages(spark, sf_dir).where("page_id % 2 = 0").select(F.col("page_id").alias("no"), "url")
    return J.statute_text(pages, url_dim=FS.url_dimension(listed))


@register("documents_quarantined")
def q_documents_quarantined(spark, sf_dir):
    """ST5: the document pages that the store with appendix could not take, with the reason;
    stored and quarantined pages together are all pages."""
    base = scratch_path(spark, "doc_quarantine")
    J.documents_with_appendix(spark, document_pages(spark, sf_dir), f"{base}/store", DEFAULT_DOMAIN,
                              quarantine_path=f"{base}/quarantine")
    return spark.read.schema("page_id long, status string").parquet(f"{base}/quarantine")


@register("linked_documents_quarantined")
def q_linked_documents_quarantined(spark, sf_dir):
    """ST5 + DS6: the linked document pages that could not be stored, with the reason."""
    base = scratch_path(spark, "link_quarantine")
    pages = with_landed(spark, sf_dir, PS.document_pages(spark, sf_dir), PS.result_pages(spark, sf_dir))
    J.pages_to_documents(spark, pages, f"{base}/store", DEFAULT_DOMAIN, quarantine_path=f"{base}/quarantine")
    return spark.read.schema("page_id long, status string").parquet(f"{base}/quarantine")


@register("crawl_rounds")
def q_crawl_rounds(spark, sf_dir):
    """ST4 + DS6: from the first result page over all pager links, storing documents."""
    base = scratch_path(spark, "crawl")
    pages = with_landed(spark, sf_dir, PS.document_pages(spark, sf_dir), PS.result_pages(spark, sf_dir, LINK_BASE))
    seeds = spark.range(1).select(F.lit(f"{LINK_BASE}tim.aspx?page=0").alias("link"))
    out = J.crawl(spark, pages, seeds, LINK_BASE, f"{base}/store", f"{base}/state", DEFAULT_DOMAIN)
    return out.select("link", F.col("round").cast("bigint").alias("round"), "n_links")
