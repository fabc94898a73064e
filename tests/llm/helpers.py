"""Small fixtures: documents with every odd case, and extra columns with clashing names."""
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 97} of{i % 13}" for i in range(20_000))
PROSE = ("the quick brown fox jumps over the lazy dog while the old grey cat sleeps near the warm fire and "
         "dreams about mice that run across the wide green field before the evening rain comes down again")

DOCS = [
    (1, PROSE, "en", "src0"), (2, None, "en", "src0"), (3, "", None, None), (4, " \n\t \n", "de", ""),
    (5, LONG, "en", "src1"), (6, PROSE, "en", "src2"), (6, PROSE, "en", "src2"), (7, PROSE + " once more", "fr", "src0"),
    (8, "café naïve – ünïcode 😀 text", "fr", "src3"), (9, "one two", "xx!", "src0"), (None, "a row without id", "en", "src0"),
]
#: Names that the operators use inside.
EXTRA = ["w", "_w", "fp", "rep", "leaf", "version", "hash", "block", "ids", "n", "score", "stratum", "_drop", "item_id",
         "declared", "host", "segments", "_key", "key", "row", "drop", "lines", "a.b", "c`d"]


def documents(spark, rows=DOCS):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    full = [(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in rows]
    df = spark.createDataFrame(full, schema)
    return df.selectExpr("*", *["'x' AS `" + c.replace("`", "``") + "`" for c in EXTRA])


def plain(df):
    return df.drop(*EXTRA)


def labels(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return df.selectExpr("*", "'x' AS text", "'x' AS stratum")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
