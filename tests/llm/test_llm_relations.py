"""Operators across documents: languages, lines, near-duplicates, leaks, conversations, the pipeline."""
import collections
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, EXTRA, LONG, PROSE, SF, documents, plain, rows_of

from statuta.llm import chat_format, decontaminate, language_id, line_templates, simhash_covering
from statuta.llm.components import connected_components
from statuta.llm.queries import REGISTRY


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- 2: language identification ---------------------------------------------

WORDS = {"en": "the of and with house green under water street number small yellow",
         "de": "der die und mit haus grün unter wasser straße nummer klein gelb",
         "fr": "le la et avec maison vert sous eau rue numéro petit jaune"}


def language_rows(n=60):
    rng = random.Random(3)
    return [(1000 * k + i, " ".join(rng.choices(text.split(), k=30)), lang, f"host{k}.example.org")
            for k, (lang, text) in enumerate(WORDS.items()) for i in range(n)]


def test_text_overrules_a_wrong_declaration(spark):
    rows = language_rows() + [(9001, " ".join(WORDS["de"].split() * 3), "fr", "host0.example.org"),
                              (9002, "12 34 !!", "en", "host0.example.org"), (9003, None, "de", None),
                              (9004, " ".join(WORDS["fr"].split() * 3), None, None), (9005, "", "bad code", "")]
    out = {r["doc_id"]: r for r in language_id.identify(
        language_id.document_evidence(documents(spark, rows)), ["doc_id"]).collect()}
    for i, _, lang, _ in language_rows():
        assert out[i]["lang"] == out[i]["text_lang"] == lang and out[i]["kept"]
    assert out[9001]["lang"] == "de" and out[9004]["lang"] == "fr"
    assert not out[9002]["kept"] and not out[9003]["kept"] and not out[9005]["kept"]
    assert out[9002]["text_lang"] is None and out[9003]["lang"] == "de"


def test_host_and_declaration_decide_an_open_text(spark):
    rows = language_rows() + [(9001, "x", None, "host1.example.org"), (9002, "x", "fr", None)]
    out = {r["doc_id"]: r["lang"] for r in language_id.identify(
        language_id.document_evidence(documents(spark, rows)), ["doc_id"]).collect()}
    assert out[9001] == "de" and out[9002] == "fr"


def test_page_evidence(spark):
    rows = [(1, "https://User@WWW.Example.ORG:8080/de/1?x=/fr/", '<!DOCTYPE html><HTML class="a" LANG=de-AT><p>Hal&amp;lo<script>var x</script>'),
            (2, "http://a.b.example.com", "<p lang='fr'>x"), (3, None, None)]
    out = language_id.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in out.withColumn("code", language_id.declared_code(F.col("declared")))
           .withColumn("parent", language_id.parent_domain(F.col("host"))).collect()}
    assert (got[1]["code"], got[1]["suffix"], got[1]["host"], got[1]["parent"]) == ("de", "/de", "www.example.org", "example.org")
    assert got[1]["text"].split() == ["Hal", "lo"]
    assert (got[2]["code"], got[2]["suffix"], got[2]["parent"]) == (None, ".com", "example.com")
    assert (got[3]["code"], got[3]["suffix"], got[3]["host"]) == (None, None, None)


def test_languages_of_the_tables(spark):
    langs = {r["doc_id"]: r["lang"] for r in table(spark, "documents").collect()}
    rows = REGISTRY["op2_language_id"](spark, SF).collect()
    assert len(rows) == len(langs) + table(spark, "pages").count()
    assert sum(r["lang"] == langs[r["doc_id"]] for r in rows if r["doc_id"] >= 0) >= 0.98 * len(langs)


def test_no_declarations_and_no_rows(spark):
    rows = [(1, PROSE, None, None), (2, None, "??", None)]
    out = language_id.identify(language_id.document_evidence(documents(spark, rows)), ["doc_id"]).collect()
    assert all(r["lang"] is None and r["kept"] for r in out)
    assert language_id.keep_identified(documents(spark, [])).count() == 0


def test_foreign_and_gibberish_texts_are_rejected(spark):
    rng = random.Random(5)
    letters = lambda: " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(12))
    odd = ["这是一个没有人声明的语言写成的句子而且没有模型像它", "это предложение написано на языке которого никто не указал",
           "αυτή η πρόταση δεν μοιάζει με καμία άλλη γλώσσα εδώ", letters(), letters()]
    rows = language_rows(400) + [(9001 + i, text, declared, "host0.example.org")
                              for i, text in enumerate(odd) for declared in [None, "en"][i % 2:i % 2 + 1]]
    out = {r["doc_id"]: r for r in language_id.identify(
        language_id.document_evidence(documents(spark, rows)), ["doc_id"]).collect()}
    assert all(out[i]["kept"] for i, *_ in language_rows(400))
    assert not any(out[9001 + i]["kept"] for i in range(len(odd)))
    assert out[9001]["text_lang"] is None and out[9004]["text_lang"] is None


def test_a_rare_language_is_modelled(spark):
    """Two texts in over 2,000 declare it; many other declared codes do not crowd it out."""
    rows = language_rows(700) + [(9001 + i, "tämä lause on kirjoitettu suomeksi ja se kertoo vanhasta talosta " * 3, "fi", "h")
                                 for i in range(2)]
    rows += [(9100 + i, f"koodi{chr(97 + i)} " * 4, f"q{chr(97 + i)}", None) for i in range(20)]
    out = {r["doc_id"]: r for r in language_id.identify(
        language_id.document_evidence(documents(spark, rows)), ["doc_id"]).collect()}
    assert all(out[9001 + i]["lang"] == out[9001 + i]["text_lang"] == "fi" and out[9001 + i]["kept"] for i in range(2))
    assert sum(out[i]["lang"] == lang for i, _, lang, _ in rows[:2100]) == 2100


# --- 3: line templates ------------------------------------------------------

def brute_lines(rows):
    """Line dedup by direct grouping of tokens."""
    mask, n = line_templates.MASK, line_templates.FIELDS
    least, of = line_templates.CONSTANT
    groups = collections.defaultdict(set)
    for i, text, *_ in rows:
        if i is None or text is None:
            continue
        for no, line in enumerate(text.split("\n")):
            raw = tuple(line.strip(" \t\x0b\x0c\r").split())
            w = tuple(re.sub(r"^\S*[0-9]\S*$", mask, t) for t in raw)
            rest = len(w) - line_templates.LEADING
            cut = [line_templates.LEADING + rest * j // n for j in range(n + 1)]
            keys = [(len(w), j, w[:cut[j]], w[cut[j + 1]:]) for j in range(n) if len(w) >= line_templates.FIELD_TOKENS]
            keys = [k for k in keys if sum(t != mask for t in k[2] + k[3]) * of >= len(w) * least]
            for k in keys or [raw] * bool(raw):
                groups[k].add((i, no))
    firsts = collections.defaultdict(set)
    for some in groups.values():
        if len({i for i, _ in some}) > 1:
            for line in some - {min(some)}:
                firsts[line].add(min(some))
    drop = {line for line, anchors in firsts.items() if anchors - set(firsts)}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for no, x in enumerate(lines) if (i, no) not in drop]
        out.append((i, text if len(left) == len(lines) else "\n".join(left), len(lines) - len(left)))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    boiler = "please read our terms and conditions before you go on"
    rows = DOCS + [
        (20, f"first own line of this text\n{boiler}\nshort line", "en", "s"),
        (21, f"{boiler}\n\nPage 3 of 17 printed at noon\nshort line", "en", "s"),
        (22, f"Page 4 of 99 printed at noon\n{boiler}\n{boiler}", "en", "s"),
        (23, "posted on the board by anna in the evening of a day", "en", "s"),
        (24, "posted on the board by bruno in the evening of a day", "en", "s"),
        (25, "posted on the board for anna at some other hour of day", "en", "s"),
        (26, "twice in one document only here\ntwice in one document only here", "en", "s"),
        (27, f"  {boiler.replace(' ', '  ')}\t", "en", "s"), (28, "\n".join([LONG] * 3), "en", "s"), (29, LONG, "en", "s")]
    assert rows_of(line_templates.dedup_lines(documents(spark, rows)), "doc_id", "text", "n_lines_dropped") == brute_lines(rows)


def test_rows_of_numbers_stay(spark):
    """Numeric rows of two documents are only cut where all their values are equal."""
    rows = [(1, "12 15 18 21 24\n7 7 7 7 7\nsales of 12 15 18 21 24 in all", "en", "s"),
            (2, "2024-01-02 3.5 4.5 9.1 -7\n  7  7 7 7 7\nsales of 22 25 28 31 34 in all", "en", "s"),
            (3, "40 41 42 43 44\nPage 3 of 17 printed at noon", "en", "s"), (4, "Page 4 of 99 printed at noon", "en", "s"),
            (5, "x1 x2 x3 x4 x5\nx1 x2 x3 x4 x5", "en", "s")]
    # the leaf "1 1 1 1 1 1" holds equal rows only
    rows += [(i, "1 1 1 1 1 1", "en", "s") for i in (6, 7)]
    got = {r["doc_id"]: r["text"] for r in line_templates.dedup_lines(documents(spark, rows)).collect()}
    want = {i: t for i, t, *_ in rows}
    want[2] = "2024-01-02 3.5 4.5 9.1 -7\nsales of 22 25 28 31 34 in all"
    want[4] = want[7] = ""
    assert got == want


def test_lines_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    assert rows_of(REGISTRY["op3_line_templates"](spark, SF), "doc_id", "text", "n_lines_dropped") == brute_lines(rows)


def test_lines_keep_other_columns(spark):
    out = line_templates.dedup_lines(documents(spark))
    assert out.columns[:len(documents(spark).columns)] == documents(spark).columns
    assert line_templates.dedup_lines(documents(spark, [])).count() == 0


# --- 6: SimHash -------------------------------------------------------------

def brute_fingerprint(text):
    words = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius):
    """points: (id, fingerprint) -> component name of each id."""
    names = {i: i for i, _ in points}
    changed = True
    while changed:
        changed = False
        for i, a in points:
            for j, b in points:
                if (a ^ b).bit_count() <= radius and names[j] < names[i]:
                    names[i], changed = names[j], True
    return names


def test_simhash_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()][:120]
    rows += [(i, t) for i, t, *_ in DOCS if i is not None]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    names = brute_components(prints, 4)
    want = sorted(((i, format(f, "016x"), names[i]) for i, f in prints), key=str)
    full = [(i, t, "en", "s") for i, t in rows]
    assert rows_of(simhash_covering.simhash_components(documents(spark, full)), "doc_id", "fingerprint", "component_id") == want


def test_masks_cover_every_pair_in_the_radius():
    masks, rng = simhash_covering.masks(4), random.Random(4)
    assert len(masks) == 31
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(difference & m == 0 for m in masks)


@pytest.mark.parametrize("bucket_rows", [2, 256])
def test_links_of_dense_groups(spark, bucket_rows):
    """Chains of near fingerprints, compared in buckets or through hubs."""
    rng, points = random.Random(6), {}
    for _ in range(8):
        f = rng.getrandbits(64)
        for _ in range(12):
            points.setdefault(f - (1 << 64) if f >> 63 else f, len(points))
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                f ^= 1 << b
    pairs = [(i, f % (1 << 64)) for f, i in points.items()]
    names = brute_components(pairs, 4)
    reps = spark.createDataFrame(list(points.items()), "fp long, rep long")
    found = connected_components(simhash_covering.links_within(reps, 4, bucket_rows))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert {i: got.get(i, i) for i, _ in pairs} == names


def test_components_of_a_long_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, 200 + i) for i in range(50)] + [(5, 5), (None, 7), (300, 299), (299, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 10 for i in range(10, 61)) and all(got[200 + i] == 100 for i in range(50))
    assert got[300] == got[299] == 299 and 5 not in got and len(got) == 51 + 51 + 2


def test_one_of_each_group_stays(spark):
    kept = simhash_covering.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 7, 8, 9]
    assert simhash_covering.keep_one(documents(spark, [])).count() == 0


def test_rows_without_an_id_are_grouped_like_others(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("ape", "bee", "cow"))
    rows = [(None, one, "en", "s"), (None, one, "en", "s"), (1, two, "en", "s"), (None, two, "en", "s"),
            (2, three, "en", "s"), (2, LONG, "en", "s"), (2, three, "en", "s")]
    kept = rows_of(corpus_pipeline.near_dedup(spark, documents(spark, rows), SF), "doc_id", "text")
    assert kept == sorted([(None, one), (1, two), (2, three), (2, LONG)], key=str)


def test_fingerprints_without_an_id_link(spark, monkeypatch):
    """Two fingerprints eight bits apart are bridged by one that only a row without id holds."""
    prints = F.expr("CASE text WHEN 'a' THEN 0 WHEN 'b' THEN 15 WHEN 'c' THEN 255 END").cast("long")
    monkeypatch.setattr(simhash_covering, "fingerprint_column", lambda text, shingle: prints)
    rows = [(1, "a", "en", "s"), (None, "b", "en", "s"), (2, "c", "en", "s")]
    out = simhash_covering.simhash_components(documents(spark, rows))
    assert [r["component_id"] for r in out.collect()] == [1, 1, 1]


def test_stages_judge_rows_without_an_id(spark):
    rows = language_rows() + [(None, "12 34 !!", "en", None), (None, WORDS["de"], "de", None), (None, PROSE, "en", None),
                              (7, "56 78", "en", None), (7, WORDS["fr"] + " maison verte", "fr", None)]
    kept = language_id.keep_identified(documents(spark, rows))
    assert {r["text"] for r in kept.where("doc_id IS NULL OR doc_id = 7").collect()} >= {WORDS["de"], WORDS["fr"] + " maison verte"}
    assert kept.where("text IN ('12 34 !!', '56 78')").count() == 0
    items = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    left = decontaminate.drop_contaminated(documents(spark, rows), items)
    assert left.where("doc_id IS NULL").count() == 2 and left.count() == len(rows) - 1


# --- 7: decontamination -----------------------------------------------------

def shingle_set(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({" ".join(words)} if words else set())


def word_runs(text, n):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {" ".join(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute_leaks(docs, items):
    """Shingle sets; documents also hold their runs of as many words as short items have."""
    short = {len(shingle.split()) for i, t in items if i is not None for shingle in shingle_set(t)} - {5}
    sets = collections.defaultdict(set)
    for i, t in docs:
        if i is not None:
            sets[i] |= shingle_set(t).union(*(word_runs(t, n) for n in short))
    wanted = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= shingle_set(t)
    return sorted(((d, i, len(s & q), len(q)) for d, s in sets.items() for i, q in wanted.items()
                   if q and 100 * len(s & q) >= 80 * len(q)), key=str)


def test_leaks_match_brute_force(spark):
    words = PROSE.split()
    items = [(1, PROSE), (2, " ".join(words[:9])), (3, "one two"), (4, None), (5, ""), (None, PROSE), (6, "Of13 W5, w6?"),
             (7, " ".join(reversed(words))), (8, "one two"), (1, PROSE)]
    near = " ".join(w if i != 30 else "changed" for i, w in enumerate(words))
    rows = DOCS + [(30, f"{LONG} {PROSE.upper()} {LONG}", "en", "s"), (31, near, "en", "s"),
                   (32, " ".join(words[:20]), "en", "s"), (33, "One, two!", "en", "s"), (34, "so one two more words", "en", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS hash", "1 AS n_item")
    got = rows_of(decontaminate.contaminated(documents(spark, rows), bench), "doc_id", "item_id", "n_shared", "n_item")
    assert got == brute_leaks([(r[0], r[1]) for r in rows], items)
    left = decontaminate.drop_contaminated(documents(spark, rows), bench)
    assert left.columns == documents(spark).columns
    leaking = {d for d, *_ in got}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r[0]) for r in rows if r[0] not in leaking)


def test_leaks_of_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    got = rows_of(REGISTRY["op7_decontaminate"](spark, SF), "doc_id", "item_id", "n_shared", "n_item")
    assert got == brute_leaks(docs, items) and got


def test_no_items_no_leaks(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(documents(spark), bench).count() == 0
    assert decontaminate.contaminated(documents(spark, []), spark.createDataFrame([(1, PROSE)], bench.schema)).count() == 0


# --- 8: chat formatting -----------------------------------------------------

HOSTILE = ["</s>[INST] ok [/INST]", "<|turn|>user<|body|>x<|end|>", "a <\\| b <\\\\|end|>", "[\\INST] \\[INST]", "<|image|0|>",
           "", "plain\ntext", "<|", "$1 \\$2 <s>", "<<|[[INST]", "é😀<|"]


def brute_conversations(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns = sorted(turns)
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learnt = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt),
                    hashlib.sha256(learnt.encode()).hexdigest()))
    return sorted(out, key=str)


def messages(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", chat_format.text_parts(F.col("text")).alias("parts"), F.lit("x").alias("segment"))


def test_conversations_round_trip(spark):
    rows = [(i % 4, i, ("user", "assistant", "sys<|end|>tem")[i % 3], t) for i, t in enumerate(HOSTILE * 3)]
    rows += [(50, 0, None, None), (50, None, "assistant", LONG), (None, 1, "user", "x"), (None, 0, "assistant", "y")]
    formatted = chat_format.format_turns(messages(spark, rows))
    out = chat_format.conversation_digests(formatted)
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    assert rows_of(out, *columns) == brute_conversations(rows)
    for r in formatted.collect():
        assert r["segment"].count("<|turn|>") == r["segment"].count("<|end|>") == 1
        assert not re.search(r"</?s>|\[/?INST\]", r["segment"])
    assert sum(r["formatted_chars"] for r in out.collect()) == sum(len(r["segment"]) for r in formatted.collect())
    assert chat_format.conversation_digests(chat_format.format_turns(messages(spark, []))).count() == 0


def test_parts_become_placeholders(spark):
    part = lambda **k: tuple(k.get(c) for c in ("type", "text", "ref", "width", "height", "duration_ms", "pages"))
    parts = [part(type="text", text="look [INST]"), part(type="image", ref="a.png", width=100, height=30),
             part(type="audio", ref="b.wav", duration_ms=161), part(type="document", ref="c.pdf", pages=3),
             part(type="image", ref=None), part(type=None, text="end")]
    schema = f"conv_id long, turn long, role string, parts {chat_format.PARTS}"
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "user", [])], schema)
    formatted = chat_format.format_turns(df)
    first, empty, none = sorted(formatted.collect(), key=lambda r: r["turn"])
    body = "look [\\INST]<|image|0|><|audio|1|><|document|2|><|image|3|>end"
    assert first["segment"] == f"<|turn|>assistant<|body|>{body}<|end|>"
    assert first["segment"][first["loss"]["start"]:first["loss"]["end"]] == body
    assert [tuple(a) for a in first["attachments"]] == [
        (0, "image", "a.png", 8), (1, "audio", "b.wav", 3), (2, "document", "c.pdf", 1536), (3, "image", None, 256)]
    assert first["n_tokens"] == 3 + 8 + 3 + 1536 + 256 + 1
    assert empty["segment"] == none["segment"] == "<|turn|>user<|body|><|end|>" and empty["n_tokens"] == 0
    back = {r["turn"]: r for r in chat_format.read_back(formatted).collect()}
    assert back[0]["text"] == back[0]["loss_text"] == "look [INST]end"


def test_conversations_of_the_table(spark):
    rows = [tuple(r) for r in table(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", HOSTILE[0]), (-1, 1, "assistant", HOSTILE[0])]
    out = REGISTRY["op8_chat_format"](spark, SF)
    assert rows_of(out, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == brute_conversations(rows)


# --- the pipeline -----------------------------------------------------------

def test_pipeline_matches_brute_force(spark):
    import tiktoken
    import public_tokenizers as P
    import corpus_pipeline
    from statuta.llm.byte_bpe import default_ranks

    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table(spark, "documents").collect()]
    kept = {r["doc_id"] for r in language_id.identify(language_id.document_evidence(table(spark, "documents")), ["doc_id"])
            .where("kept").collect()}
    rows = [(i, t) for i, t, _ in brute_lines([d for d in docs if d[0] in kept])]
    names = brute_components([(i, brute_fingerprint(t)) for i, t in sorted(rows)], 4)
    rows = [(i, t) for i, t in rows if names[i] == i]
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    leaking = {d for d, *_ in brute_leaks(rows, items)}
    enc = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=default_ranks(), special_tokens={})
    want = sorted(((i, len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest())
                   for i, t in rows if i not in leaking), key=str)
    assert rows_of(corpus_pipeline.run(spark, SF), "doc_id", "n_tokens", "decoded_sha256") == want


def test_stages_take_odd_documents(spark):
    import corpus_pipeline

    for rows in (DOCS, []):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, documents(spark, rows), SF)
            assert out.columns == documents(spark, rows).columns
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, documents(spark, rows), SF).count() == len(rows)
    assert set(EXTRA).isdisjoint(plain(documents(spark)).columns)
