"""The operators against plain versions, over odd texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from veilframe.llm import (
    boosting, bpe, chat, components, html_layout, line_rules, positional_index, quality_gam, queries, simhash, site_lines, toxicity, trie_tokens,
)

PATH, PATTERN = queries.vocabulary()
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def texts():
    """Odd texts: NULL, empty, white space of all kinds, one word, ties, very long, signs, emoji."""
    return [
        None, "", " ", "\n\n", "word", "word", "a b c d e f g h " * 40, "x" * 5000, "tab\tfeed\x0b\x0cend\r\n\x1cunit\x85nel\xa0nbsp", "é È ß 日本語 🙂🙂 é",
        "don't we're I'll 's 12345 !!?? ...", "The end.\nThe end.\nThe end.\n", "| a | b |\n" * 5, "lots of  double   spaces \n and\n\nlines \t ", "z " * 30_000,
        "\u0000nul\u0000 byte", "<p>&amp; #*$%&|<></p>",
    ]


@pytest.fixture(scope="session")
def odd(spark, texts):
    """The texts as documents with a column that clashes with a result, repeated and NULL keys, and a repeated row."""
    rows = [(None if i == 3 else i, t, "s", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], rows[6]], "doc_id long, text string, source string, n_words int").repartition(3)


def connect(tmp_path, **tables):
    """DuckDB with the given DataFrames as tables."""
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
    return con


# line rules


def test_line_rules_equal_sql_on_odd_texts(spark, odd, tmp_path):
    con = connect(tmp_path, documents=odd)
    made = line_rules.clean_lines(odd).withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")
    assert check.compare(made, con, queries.SQL["op1_line_rules"]) == []


def test_repeated_words_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice(b"ab").to_bytes() for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            words = words + words[: rng.randrange(0, 12)]
        at = defaultdict(list)
        for i in range(len(words) - 7):
            at[tuple(words[i : i + 8])].append(i)
        covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
        assert line_rules.repeated_words(words) == len(covered)


def test_line_rules_of_a_page(spark):
    prose = "The quick brown fox jumps over the lazy dog near the old river bank.\n" + "Nobody knew why it ran so far away from home today.\n"
    page = "Home | News | Sport |\n" + prose + "All rights reserved.\n" + "and then it stops without a mark\n"
    kept, text = spark.createDataFrame([(1, page)], "doc_id int, text string").transform(line_rules.clean_lines).select("kept", "clean_text").first()
    assert kept and text == prose


# dialogues


def test_rotation_equals_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, *range(300)]), rng.choice([None, "ann", "bob", "system", "eve"]), rng.choice([None, "", "hi", "yes"]), 1) for _ in range(900)]
    rows += [(9, 0, "system", "alone", 1), rows[0], rows[0]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    con = connect(tmp_path, conversations=turns)
    assert check.compare(chat.rotate(turns, block=7), con, queries.SQL["op2_chat_rotation"]) == []
    assert chat.rotate(turns.limit(0)).count() == 0


def test_masks_cover_the_words_of_the_assistant(spark):
    turns = spark.createDataFrame([(1, 0, "ann", "hello"), (1, 1, "bob", "hi ann"), (1, 2, "ann", "bye")], "conv_id int, turn int, role string, text string")
    rows = chat.rotate(turns).where("perspective = 'ann'").orderBy("seq").collect()
    text = "".join(r["segment"] for r in rows)
    assert text == "<|start|>assistant\nhello<|end|>\n<|start|>user name=bob\nhi ann<|end|>\n<|start|>assistant\nbye<|end|>\n"
    assert [text[r["mask_start"] : r["mask_end"]] for r in rows if r["trained"]] == ["hello<|end|>\n", "bye<|end|>\n"]


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, odd, library):
    encoded = bpe.encode(odd, PATH, PATTERN)
    back = bpe.decode(encoded.withColumn("decoded", F.lit(1)), PATH, PATTERN)
    assert back.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded"]
    got = Counter(tuple(r) for r in back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256)).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for key, text in [tuple(r) for r in odd.select("doc_id", "text").collect()]:
        ids = library.encode_ordinary(text or "")
        want[key, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())] += 1
    assert got == want
    assert Counter(tuple(r) for r in bpe.round_trip(odd, PATH, PATTERN).collect()) == want
    assert bpe.decode(bpe.encode(odd.limit(0), PATH, PATTERN), PATH, PATTERN).count() == 0


def test_bpe_of_long_words_and_random_text(library):
    rng = random.Random(2)
    made = bpe.Codec(PATH, PATTERN)
    some = ["a" * 3001, "=" * 2000, "ab" * 900, "日本" * 400, "".join(rng.choice("abc") for _ in range(1500)), "".join(rng.choice("ACGT") for _ in range(1500))]
    some += ["".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(0xA0, 0x3000)])) for _ in range(200)) for _ in range(50)]
    some += ["".join(rng.choice(" \n\tab.1'") for _ in range(60)) for _ in range(300)]
    assert made.encode(some) == [" ".join(map(str, library.encode_ordinary(t))).encode() for t in some]


@pytest.mark.parametrize("letters", ["ACGT", "abcdefghijklmnopqrstuvwxyz", "aéß日本", "a"])
def test_bpe_of_very_long_mixed_words(library, letters):
    rng = random.Random(3)
    made = bpe.Codec(PATH, PATTERN)
    word = "".join(rng.choice(letters) for _ in range(100_000))
    assert made.encode([word, word[:1000]]) == [" ".join(map(str, library.encode_ordinary(t))).encode() for t in (word, word[:1000])]


@pytest.mark.parametrize("size, around", [(1, 1), (3, 1), (48, 4)])
def test_pieces_of_any_size_give_the_same_ids(library, monkeypatch, size, around):
    rng = random.Random(4)
    monkeypatch.setattr(bpe, "PIECE", size)
    monkeypatch.setattr(bpe, "AROUND", around)
    made = bpe.Codec(PATH, PATTERN)
    for letters in ("abcdeé", "a", "theingon", "aA1"):
        words = ["".join(rng.choice(letters) for _ in range(n)) for n in (2, 50, 61, 300)]
        words = [w for w in words if len(library.encode_ordinary(w)) > 1 and len(made.split(w)) == 1]
        got = made.in_pieces([w.encode() for w in words])
        assert [got[w.encode()] for w in words] == [library.encode_ordinary(w) for w in words]


def test_new_words_are_learned_some_at_a_time(library, monkeypatch):
    rng = random.Random(5)
    made = bpe.Codec(PATH, PATTERN, remembered=1)
    sizes, learn = [], made.learn
    monkeypatch.setattr(made, "learn", lambda words: (sizes.append(len(words)), learn(words)))
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(9, 300 if k % 50 == 0 else 14))) for k in range(1500)) for _ in range(2)]
    assert made.encode(texts) == [" ".join(map(str, library.encode_ordinary(t))).encode() for t in texts]
    assert sum(sizes) > 2500 and max(sizes) < 2000


def test_workers_keep_no_database_between_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "per_text", lambda docs, key, text, fields, run: run)
    encode, both = bpe.encode(None, PATH, PATTERN), bpe.round_trip(None, PATH, PATTERN)
    for text in ("abqxzé abqxzéé", "abqxzé zzyqqx"):  # the second time some words are known
        digest = hashlib.sha256(" ".join(map(str, library.encode_ordinary(text))).encode()).hexdigest()
        assert encode([text.encode()])[1] == [digest]
        assert both([text.encode()])[1:] == [[digest], [hashlib.sha256(text.encode()).hexdigest()]]
        for own in (bpe.codec(PATH, PATTERN), bpe.codec(PATH, PATTERN, bpe.REMEMBERED)):
            assert "abqxzéé" in "".join(own.words) and "con" not in vars(own)


@pytest.mark.parametrize("size", [300, 1000, 3000, 100_000])
def test_bpe_is_no_slower_for_long_words(size):
    rng = random.Random(size)
    made = bpe.Codec(PATH, PATTERN)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)) for _ in range(max(1, 30_000 // size))]
    start = time.process_time()
    made.encode(words)
    # 60 kB/s and more are usual; a word that costs the square of its length takes minutes
    assert time.process_time() - start < 10


# models


def test_trees_find_a_step_and_an_interaction():
    rng = np.random.default_rng(1)
    values = rng.random((4000, 3))
    label = ((values[:, 0] > 0.5) ^ (values[:, 1] > 0.3)).astype(float)
    model = quality_gam.fit(values, label)
    assert ((model.score(values) > 0.5) == label).mean() > 0.97
    # the score is the sum of looked-up entries
    codes = boosting.binned(values[:5], model.cuts)
    by_hand = [
        model.start + sum(model.tables[j][c[j]] for j in range(3)) + sum(t[c[a], c[b]] for (a, b), t in model.pairs.items()) for c in codes
    ]
    assert np.allclose(model.raw(codes), by_hand)


def test_calibration_has_not_seen_the_label(spark):
    """A unit that stands only in toxic texts of one fold is unknown to the lexicon that leaves that fold out."""
    fold = F.pmod(F.xxhash64("key"), F.lit(toxicity.FOLDS)).cast("int")
    rows = spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 2).cast("double").alias("label")).withColumn("fold", fold)
    word = F.when((F.col("label") == 1) & (F.col("fold") == 2), "zzyzx").when(F.col("label") == 1, "quux").otherwise("plain")
    rows = rows.withColumn("text", F.concat_ws(" ", F.lit("some words"), word))
    whole, *without = toxicity.learn_units(rows)
    assert b"zzyzx " in whole and b"quux " in whole
    assert [b"zzyzx " in w for w in without] == [True, True, False, True] and all(b"quux " in w for w in without)


def test_isotonic_line_by_brute_force():
    at, to = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(to) >= 0).all() and np.interp([0.1, 0.2, 0.3, 0.4], at, to).tolist() == [0, 0.5, 0.5, 1]


@pytest.mark.parametrize("module, name, least", [(quality_gam, "quality", 0.95), (toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, module, name, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = module.score(docs, module.train(docs, labels))
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", name).collect()
    assert np.mean([r[0] == r[1] for r in rows]) >= least
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0


@pytest.mark.parametrize("module, name", [(quality_gam, "quality"), (toxicity, "toxic")])
def test_models_of_odd_rows(spark, odd, module, name):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in (0, 1, 5, 7, 7, 8, 9)] + [(None, 1, 1), (10, None, 1)], f"doc_id long, {name} int, score int")
    for some in (labels, labels.limit(0), labels.where(f"{name} = 1")):
        rows = module.score(odd, module.train(odd, some)).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(odd.limit(0), module.train(odd.limit(0), labels)).count() == 0


def test_held_out_keys(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, text string")
    import zlib

    got = {r[0]: r[1] for r in quality_gam.score(rows, quality_gam.fit(np.empty((0, 15)), np.empty(0))).select("doc_id", "held_out").collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


# benchmark index


def test_index_equals_sql_on_odd_texts(spark, odd, tmp_path, monkeypatch):
    items = ["word", "a b c d e f g h a b c d e f", None, "", "z z z z", "we re I ll", "The end The", "zzz"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*items, items[1]])] + [(1, "word", 1)], "item_id long, text string, n_hit int")
    con = connect(tmp_path, documents=odd, benchmark=bench)
    shape = lambda found: found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), positional_index.sha_of_items().alias("items_sha256"), "contaminated",
        F.size("near_items").cast("bigint").alias("n_near"), positional_index.sha_of_items("near_items").alias("near_sha256"),
    )
    judged = lambda: positional_index.decontaminate(odd, bench, slop=positional_index.SLOP)
    assert check.compare(shape(judged()), con, queries.SQL["op6_positional_index"]) == []
    clean = positional_index.keep_clean(odd, bench)
    assert clean.columns == odd.columns
    assert clean.count() == odd.count() - positional_index.decontaminate(odd, bench).where("contaminated").count()
    monkeypatch.setattr(positional_index, "BLOCK_BYTES", 20)  # several blocks
    assert len(list(positional_index.blocks(bench))) > 2
    assert check.compare(shape(judged()), con, queries.SQL["op6_positional_index"]) == []
    assert positional_index.decontaminate(odd, bench.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, item), (2, item.replace("five", "five and a half")), (3, item.replace(" ", " x " * 9)), (4, "one two"), (5, item.replace("five", "half"))], "doc_id int, text string")
    bench = spark.createDataFrame([(5, item)], "item_id int, text string")
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in positional_index.decontaminate(docs, bench, slop=3).collect()}
    assert got == {1: (["5"], []), 2: ([], ["5"]), 3: ([], []), 4: ([], []), 5: ([], ["5"])}


def plain_near(text, item, slop):
    """An item is near by the shortest run of words, over all choices of places."""
    own, words = positional_index.words((text or "").encode()), positional_index.words(item.encode())
    at = defaultdict(list)
    for i, w in enumerate(own):
        at[w].append(i)
    for k in range(max(1, len(words) - 12) if words else 0):
        window = words[k : k + 13]
        distinct = list(dict.fromkeys(window))
        there = [t for t in distinct if at[t]]
        terms = sorted(there, key=lambda t: len(at[t]))[:3]
        spans = [max(c) - min(c) + 1 for c in itertools.product(*[at[t] for t in terms])] if terms else []
        if len(there) >= len(distinct) - len(distinct) // 8 and spans and min(spans) <= len(window) + slop:
            return True
    return False


def test_proximity_by_brute_force_under_any_partitioning(spark):
    rng = random.Random(11)
    items = {str(i): " ".join(rng.choices("abcdefghijklmnopqrs", k=n)) for i, n in enumerate([2, 3, 4, 5, 8, 13, 14, 16])}
    rows = [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvw", k=rng.randrange(0, 90)))) for i in range(120)]
    for i, item in enumerate(items.values()):  # one word replaced, one word put in
        words = item.split()
        rows += [(200 + i, " ".join([*words[:1], "new", *words[2:]])), (300 + i, " ".join([*words[:1], "new", *words[1:]]))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id string, text string")
    near = {i: {k for k, item in items.items() if plain_near(text, item, 2)} for i, text in rows}
    assert sum(map(len, near.values())) > 50
    for n in (1, 3, 40):
        for r in positional_index.decontaminate(docs.repartition(n), bench, slop=2).collect():
            assert set(r["near_items"]) == near[r["doc_id"]] - set(r["items"])


def test_proximity_takes_the_shortest_run():
    # places of the rarest term, and of others before and behind it
    assert positional_index.least_span([np.array([100]), np.array([95, 106]), np.array([107])]) == 8
    assert positional_index.least_span([np.array([5])]) == 1


# token counts


def test_trie_counts_by_brute_force(spark, odd):
    pieces = trie_tokens.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    far = min(pieces.values()) - trie_tokens.FAR

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways = [(best[k][0] + pieces[word[k:end]], -(-best[k][1] + 1)) for k in range(max(0, end - 20), end) if word[k:end] in pieces]
            if word[end - 1] not in pieces:
                ways.append((best[-1][0] + far, best[-1][1] - len(word[end - 1].encode())))
            best.append(max(ways))
        return best[-1][0], -best[-1][1]

    def whole(text):
        made = [plain(trie_tokens.START + w) for w in ASCII_WORD.findall(text or "")]
        return len(made), sum(m[1] for m in made), float(sum(m[0] for m in made))

    memo = {t: whole(t) for t in {r["text"] for r in odd.select("text").collect()} if t is None or len(t) < 40_000}
    got = trie_tokens.count_tokens(odd, public_tokenizers.path("piece_bpe_32k.model"))
    both = Counter((r["doc_id"], r["n_words"], r["n_tokens"], r["score"]) for r in got.collect())
    want = Counter((r["doc_id"], *(memo[r["text"]] if r["text"] in memo else whole(r["text"]))) for r in odd.collect())
    assert both == want


# pages


@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("plain &lt;text&gt;", "plain <text>"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("<head><title>t</title><style>x</style></head><script>var a='<p>'</script><p>seen<span hidden>no</span><b style='display: none'>no</b>", "seen"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>end", "- a\n- b\n  3. c\n  4. d\n\nend"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>", "name       n\nlong name  1\nx          22"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<pre> x\n  y</pre>z", " x\n  y\n\nz"),
    ("<b>a</b> <i>b</i>   c\n d", "a b c d"),
    ("<blockquote>q</blockquote><hr>", "  q\n\n---"),
    ("</p></div>stray<td>cell", "stray\ncell"),
    ("<!-- c --><p>x<input type=hidden value=1></p>", "x"),
])
def test_layout(html, text):
    assert html_layout.extract(html) == text


@pytest.mark.parametrize("html, text", [
    ("<head><title>t</title><body>plain text<br>more text", "plain text\nmore text"),
    ("<head><title>t</title>text<br>more", "text\nmore"),
    ("<head><title>t</title><br>text<hr>more", "text\n\n---\n\nmore"),
    ("<head><title>t</title> <meta charset=utf-8>\n<style>x</style><img src=a>text", "text"),
    ("<head><title>t</title><input>text", "text"),
    ("<html><head><title>t</title><script>a</script></head><body>text</body></html>", "text"),
])
def test_layout_of_an_open_head(html, text):
    assert html_layout.extract(html) == text


@pytest.mark.parametrize("html, text", [
    ("<table><tbody><td>a<td>b</table>", "a  b"),
    ("<table><td>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><tbody>loose<tr><td>a</table>", "loose\na"),
    ("<table><tbody><div>loose</div><tr><td>a</table>", "loose\na"),
    ("<table><tbody><form><tr><td>a<td>b</form></table>", "a  b"),
    ("<table><tr><form><td>a<td>b</form></table>end", "a  b\n\nend"),
    ("<form><table><tbody><tr><td>a</form><tr><td>b</table>c</form>", "a\nb\n\nc"),
    ("<table><colgroup><col><tr><td>a</table>", "a"),
    ("<table><caption>name<td>a</table>", "name\na"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<tbody><tr><td>e<td>f</table>", "a  b\n   c\n   d\ne  f"),
    ("<table><tr><td>a<td colspan=2 rowspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
    ("<textarea>one\ntwo</textarea>", "one\ntwo"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<math><mi>x</mi><annotation>no</annotation></math>", "x"),
    ("<svg><title>no</title><defs><text>no</text></defs><text>yes</text></svg>", "yes"),
    ("<object data=x>instead</object>", "instead"),
])
def test_layout_shows_all_visible_text(html, text):
    assert html_layout.extract(html) == text


def test_layout_of_deep_and_odd_pages(spark, odd):
    assert html_layout.extract("<div>" * 20_000 + "deep").strip() == "deep"
    rows = html_layout.extract_pages(odd, "doc_id", "text").collect()
    assert len(rows) == odd.count() and all(r["text"] is not None for r in rows)


# site lines


def test_site_lines_equal_sql(spark, tmp_path):
    rng = random.Random(4)
    lines = ["menu", " menu ", "foot", "", " ", "a", "b", "c", "d"]
    rows = [(i, None if i % 17 == 0 else "\n".join(rng.choices(lines, k=rng.randrange(0, 5))), rng.choice([None, "x", "y"]), i) for i in range(80)]
    rows += [rows[1]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_pages int")
    con = connect(tmp_path, documents=docs)
    made = site_lines.drop_boilerplate(docs, ratio=0.3, counts=("n_lines", "n_dropped"))
    sql = queries.SQL["op9_site_lines"].replace(str(site_lines.RATIO), "0.3")
    assert check.compare(made.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256")), con, sql) == []
    assert site_lines.drop_boilerplate(docs).columns == docs.columns
    assert site_lines.drop_boilerplate(docs.limit(0)).count() == 0


def test_site_lines_of_small_hosts_and_copies(spark, tmp_path):
    rows = [(i, f"menu\npage {i}", "small") for i in range(3)] + [(10 + i, f"text {i}", "big") for i in range(30)]
    rows += [(100 + i, "copied\nwhole", "big") for i in range(10)] + [(200 + i, None, None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = site_lines.drop_boilerplate(docs, counts=("n_lines", "n_dropped"))
    left = {r["doc_id"]: r["text"] for r in made.collect()}
    assert left == {k: f"page {k}" if s == "small" else t for k, t, s in rows}
    con = connect(tmp_path, documents=docs)
    shape = made.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))
    assert check.compare(shape, con, queries.SQL["op9_site_lines"]) == []


def test_the_pipeline_keeps_copied_texts_and_cleans_small_hosts(spark):
    rows = [(i, f"menu\npage {i}", "small", 9) for i in range(3)] + [(10 + i, "copied\nwhole", "big", 9) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert left == {k: f"page {k}" if s == "small" else t for k, t, s, _ in rows}


# near copies


def plain_print(text):
    words = ASCII_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(keys, prints):
    """Smallest key of each class, by comparing all pairs."""
    label = list(range(len(prints)))
    bits = np.array(prints, np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(bits)):
            low = min(label[j] for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 4))
            if low < label[i]:
                label[i], changed = low, True
    return [min(keys[j] for j in range(len(keys)) if label[j] == label[i]) for i in range(len(keys))]


def test_simhash_by_brute_force(spark, odd):
    rows = [(r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in odd.collect()]
    rng = random.Random(6)
    base = [rng.choices("abcdefghijklmnop", k=80) for _ in range(12)]
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(80)] = rng.choice("xyz")
        rows.append((1000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in simhash.classes(docs).select("doc_id", simhash.hex_of("fp"), "component_id").collect())
    prints = [plain_print(t) for _, t in rows]
    want = sorted((k, f"{p:016x}", c) for (k, _), p, c in zip(rows, prints, plain_classes([k for k, _ in rows], prints)))
    assert got == want
    kept = simhash.keep_first(docs.withColumn("fp", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "fp"] and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in want})
    assert simhash.classes(docs.limit(0)).count() == 0


def test_dense_groups_are_split_and_whole(spark):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:3]:
        for _ in range(150):
            q = p
            for _ in range(rng.randrange(1, 6)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = plain_classes(signed, prints)
    for group in (5, 64, 4096):
        made = {r["node"]: r["component"] for r in components.components(simhash.links(nodes, group=group)).collect()}
        assert [made.get(p, p) for p in signed] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 130)] + [(200, 200), (301, 300), (300, 301)]
    made = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100), 300: 300, 301: 300}
