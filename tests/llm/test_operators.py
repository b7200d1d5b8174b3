"""Every operator against brute force, an exact round trip or held-out accuracy, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reviewlake.llm import op01_packing, op02_language, op03_suffixes, op04_quality, op05_toxicity, op06_elias_fano
from reviewlake.llm import op07_parsing, op08_bpe, op09_simhash, op10_repetition
from reviewlake.llm.common import held_out, ship
from reviewlake.llm.tokens import library_encoder, rank_encoding
from reviewlake.session import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"


def frame(spark, *texts, start=0):
    """Rows with extra columns whose names clash with results, a null id and a repeated row."""
    ship(spark)
    rows = [(start + i, t, None, "s", None if t is None else len(t), 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    passage = " ".join(rng.choice(words) for _ in range(60))

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    texts = [text(rng.randrange(1, 300)) for _ in range(40)]
    texts += [texts[3], texts[3] + " more", None, "", " ", "é ß 中文  \n\t x", "ab " * 400, "z" * 5000, text(9000)]
    texts += [f"{text(20)} {passage} {text(20)}" for _ in range(8)]
    return texts


@pytest.fixture(scope="module")
def docs(spark, prose):
    rows = frame(spark, *prose)
    again = rows.filter("doc_id = 5")  # a repeated row
    nameless = frame(spark, "one text without an id, and " + prose[0]).withColumn("doc_id", F.lit(None).cast("long"))
    return rows.unionByName(again).unionByName(nameless).repartition(5).persist()


def by_row(df):
    return sorted(map(tuple, df.collect()), key=str)


def library():
    tokenizer = Tokenizer.from_file(op01_packing.VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_units_encode_as_whole_texts():
    rng = random.Random(1)
    letters = " \n\t\x1c\x85\xa0​　ab1.'s_中é<|endoftext|>𝒳\0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)] + [None, ""]
    ids, bounds = library_encoder(op01_packing.VOCABULARY).encode(pa.array(texts))
    whole = library()
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == whole(text), repr(text)


def test_packing_covers_every_id_once(docs):
    whole = library()
    pieces = op01_packing.pack_documents(docs, with_ids=True).toPandas()
    expected = {}
    for row in docs.collect():
        expected.setdefault(row.doc_id, []).append(whole(row.text) + [1])
    for doc_id, group in pieces.groupby("doc_id", dropna=False):
        lists = expected[None if np.isnan(doc_id) else int(doc_id)]
        ids = lists[0]
        assert group["length"].sum() == sum(map(len, lists))
        for p in group.itertuples():
            own = ids[p.start : p.start + p.length]
            assert list(p.ids) == own and crc(own) == p.ids_crc32 and p.doc_tokens == len(ids)
    for _, group in pieces.sort_values("offset").groupby("sequence_id"):
        assert (group["offset"] == group["length"].cumsum() - group["length"]).all() and group["length"].sum() <= 2048
    used = pieces.groupby("sequence_id")["length"].sum()
    assert sorted(used.index) == list(range(len(used)))
    assert used.sum() / (2048 * len(used)) > 0.9


def test_remainders_are_cut_whole():
    table = op01_packing.remainder_cuts(2048)
    assert all(sum(table[n]) == n and len(table[n]) <= 3 for n in range(2048))


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [3, 3, 900, 10**12], list(range(0, 5000, 7))])
def test_elias_fano_round_trip(values):
    coded = op06_elias_fano.EliasFano.from_bytes(op06_elias_fano.EliasFano.of(np.array(values)).to_bytes())
    assert coded.select_block(0, len(values)).tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values
    for i, j in ((0, 1), (1, 2), (255, 257), (256, 513), (3, 700), (700, 715)):
        if j <= len(values):
            assert coded.select_block(i, j).tolist() == values[i:j]


def test_id_width_follows_the_vocabulary(spark, docs, monkeypatch):
    few = docs.filter("doc_id < 3")
    wide = op06_elias_fano.write_shards(few, shared_dir(spark, "wide"), end_id=70_000)
    assert all(r.path.endswith(".tok4") for r in wide.collect())
    assert {r.ids[-1] for r in op06_elias_fano.read_shards(wide).collect()} == {70_000}
    with pytest.raises(Exception, match="does not fit"):
        op06_elias_fano.write_shards(few, shared_dir(spark, "narrow"), end_id=70_000, id_bytes=2)


def test_shards_give_back_all_documents(spark, docs):
    whole = library()
    shards = op06_elias_fano.write_shards(docs, shared_dir(spark, "shards"))
    read = op06_elias_fano.read_shards(shards).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for got, row in zip(read, rows, strict=True):
        ids = whole(row.text) + [0]
        assert (got.doc_id, got.start, got.ids) == (row.doc_id, at, ids)
        at += len(ids)
    shard = op06_elias_fano.Shard(shards.orderBy("shard").first().path)
    assert shard.document(0).tolist() == read[0].ids


def test_bpe_round_trip(docs):
    encoding = rank_encoding(op08_bpe.RANKS)
    tokens = op08_bpe.decode_ids(op08_bpe.encode_texts(docs.select("doc_id", "text")))
    for row in tokens.collect():
        assert row.ids == encoding.encode_ordinary(row.text or "") and bytes(row.bytes).decode() == (row.text or "")


def test_bpe_digests(docs):
    encoding = rank_encoding(op08_bpe.RANKS)
    expected = []
    for row in docs.collect():
        ids = encoding.encode_ordinary(row.text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (row.text or "").encode())]
        expected.append((row.doc_id, len(ids), *digests))
    assert by_row(op08_bpe.round_trip(docs)) == sorted(expected, key=str)
    assert op08_bpe.round_trip(docs.limit(0)).count() == 0


def test_long_texts_are_cut_safely():
    text = "word, 12  \n\n end. " * 40 + "x" * 300 + " tail"
    encoding = rank_encoding(op08_bpe.RANKS)
    parts = list(op08_bpe.chunks(text, 50))
    assert "".join(parts) == text and len(parts) > 10
    assert [i for p in parts for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_texts_are_not_cut_at_information_separators():
    text = "!\x1c!" * 20_000 + " a\x1fb" * 10_000
    encoding = rank_encoding(op08_bpe.RANKS)
    assert [i for p in op08_bpe.chunks(text, 50) for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_very_long_white_space():
    encoding = rank_encoding(op08_bpe.RANKS)
    for space in (" ", "\n", " \n\t"):
        for text in (space * 12_000, f"a{space * 12_000}", f"{space * 12_000}b c", f"a {space * 11_000}.b{space * 11_000} 1 {space}"):
            assert op08_bpe.encode_text(text, encoding) == encoding.encode_ordinary(text)
        text = f"a{space * 700_000}b"
        assert encoding.decode(op08_bpe.encode_text(text, encoding)) == text


def brute_suffixes(rows, length=op03_suffixes.LENGTH):
    """(n_bytes, n_removed, n_spans, kept) of (key, text) rows in order; equal keys are one document."""
    seen, out = {}, {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            first = seen.setdefault(data[s : s + length], (key, s))
            if first != (key, s):
                gone[s : s + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out[key] = (len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("large", [20_000, 0])
def test_suffixes_against_brute_force(docs, monkeypatch, large):
    monkeypatch.setattr(op03_suffixes, "LARGE_BUCKET", large)
    expected = brute_suffixes([(-1 if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()])
    got = op03_suffixes.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == expected[-1 if r.doc_id is None else r.doc_id]
    assert sum(r.n_removed for r in got) > 5000


def test_suffix_order_with_a_difference_cover():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 99, 400), np.tile([97, 98, 99], 300), rng.integers(97, 99, 400)]).astype(np.uint8)
    windows = np.arange(len(data) - op03_suffixes.LENGTH + 1)
    order, equal = op03_suffixes.sort_windows(data, windows)
    texts = [data[i : i + op03_suffixes.LENGTH].tobytes() for i in order]
    assert texts == sorted(texts)
    assert equal.tolist() == [False] + [a == b for a, b in zip(texts, texts[1:], strict=False)]


def test_fingerprints_are_local_and_deterministic(docs, prose):
    texts = [t or "" for t in prose]
    together = op07_parsing.fingerprints(texts)
    assert all((together[i] == op07_parsing.fingerprints([t])[0]).all() for i, t in enumerate(texts))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or ""))
    own = [r.text or "" for r in rows]
    edited = [op07_parsing.edit(a, b) for a, b in zip(own, own[1:] + own[:1], strict=True)]
    got = op07_parsing.compare_with_next(docs).toPandas()
    expected = sorted((len(t), hashlib.sha256(e.encode()).hexdigest()) for t, e in zip(own, edited, strict=True))
    assert sorted(zip(got["n_chars"], got["edited_sha256"], strict=True)) == expected
    long = got[got["n_chars"] > 500]
    # a text of one repeated letter is one run, which an edit renames
    assert (long["near_edited"] > 0.3).mean() > 0.9 and long["near_edited"].mean() > long["near_next"].mean() + 0.3


def brute_simhash(text):
    words = bytes((text or "").encode()).lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_against_brute_force(spark):
    rng = random.Random(9)
    centre = [rng.getrandbits(64) for _ in range(30)]
    values = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centre for _ in range(8)]
    signed = [v - 2**64 if v >= 2**63 else v for v in set(values)]
    found = op09_simhash.components(op09_simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")))
    root = {v: v for v in signed} | {r.node: r.root for r in found.collect()}
    groups = {v: v for v in signed}

    def top(v):
        while groups[v] != v:
            v = groups[v]
        return v

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                groups[top(a)] = top(b)
    pairs = {(root[v], top(v)) for v in signed}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_simhash_fingerprints_and_classes(docs):
    rows = {(r.doc_id, r.fp, r.component_id) for r in op09_simhash.near_duplicates(docs).collect()}
    prints = {(r.doc_id, brute_simhash(r.text)) for r in docs.collect()}
    assert {(i, fp % 2**64) for i, fp, _ in rows} == prints
    component = {i: c for i, _, c in rows}
    assert component[40] == 3 and component[42] == component[43] == component[44] == 42
    kept = op09_simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (3, 40)").count() == 1 == kept.filter("doc_id = 5").count()


def test_near_duplicates_without_own_ids(spark, prose):
    far = [t for t in prose if t and len(t.split()) > 60][:4]
    rows = frame(spark, *far, far[0]).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.lit(7)))
    # no id: two texts; id 7: two texts and a copy of one without id
    kept = [(r.doc_id, r.text) for r in op09_simhash.keep_one(rows).collect()]
    assert sorted(kept, key=str) == sorted([(7, far[0]), (None, far[1]), (7, far[2]), (7, far[3])], key=str)


def test_repetition_counts():
    line = "one two three four five six seven eight nine ten eleven"
    n, chars, symbols, lines, repeat, base, *_, kept = op10_repetition.judge(f"{line}\n{line}\n# a|b")
    assert (n, chars, symbols, lines, repeat, base, kept) == (24, 2 * len(line.replace(" ", "")) + 4, 2, 1, 22, True, False)
    assert op10_repetition.judge(None)[:6] == (0, 0, 0, 0, 0, True)
    assert op10_repetition.judge(" ".join(map(str, range(100))))[-1] is True


def test_repetition_report_and_filter(docs):
    got = {(r.doc_id, r.kept) for r in op10_repetition.report(docs).collect()}
    assert (42, False) in got and (46, False) in got and (48, True) in got
    kept = op10_repetition.keep_clean(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in op10_repetition.report(docs).collect())


def test_repeated_words_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(60))]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert op10_repetition.judge(" ".join(words))[4] == len(marked)


SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = op02_language.documents(spark, SF)
    got = op02_language.op2_language_by_compression(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    odd = frame(spark, None, "", "12 \u00b2 \u00bd.,", "words of no language")
    dictionaries = op02_language.learn(docs.filter(~held_out(F.col("doc_id"))))
    assert [r.lang_pred for r in op02_language.predict_languages(odd, dictionaries).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r.lang_pred for r in op02_language.predict_languages(odd, []).collect()} == {"und"}


def test_quality_on_held_out_rows(spark):
    got = op04_quality.op4_pairwise_quality(spark, SF).join(op04_quality.labels(spark, SF), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def test_toxicity_on_held_out_rows(spark):
    got = op05_toxicity.op5_toxicity_automata(spark, SF).join(op05_toxicity.labels(spark, SF), "doc_id").filter("held_out")
    assert got.filter("toxic = 0 and predicted = 1").count() <= 2
    assert got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.93


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_against_edit_distance():
    rng = random.Random(4)
    terms = ["banana", "cabana", "candy", "abc"]
    automaton = op05_toxicity.LexiconAutomaton([(t, False) for t in terms] + [("nabob", True)])
    words = ["".join(rng.choice("abcndy") for _ in range(rng.randrange(2, 9))) for _ in range(4000)] + terms
    words += [t[:i] + c + t[i + k :] for t in terms for i in range(len(t)) for c in ("", "x", "ab") for k in (0, 1)]
    for word in words:
        if word.startswith("nabob"):
            continue
        exact = word in terms
        near = any(edits(word, t) == 1 for t in terms if len(t) >= op05_toxicity.FUZZY_CHARS)
        assert automaton.match(word) == (1 if exact else 2 if near else 0), word
    assert automaton.match("nabobery") == 1


def test_quotation_is_not_abuse():
    automaton = op05_toxicity.LexiconAutomaton([("wretch", False)])
    abuse, wrong, quoted = (op05_toxicity.evidence(t, automaton) for t in ("you wretch", "you wrretch", 'they said "wretch" then'))
    assert abuse[0] > 0 and wrong[1] > 0 and quoted[2] > 0 and quoted[0] == 0
    assert op05_toxicity.evidence(None, automaton) == [0.0, 0.0, 0.0]


def test_empty_tables(spark):
    none = frame(spark, "x").limit(0)
    assert op01_packing.pack_documents(none).count() == 0
    assert op03_suffixes.remove_repeats(none).count() == 0
    assert op06_elias_fano.read_shards(op06_elias_fano.write_shards(none, shared_dir(spark, "none"))).count() == 0
    assert op07_parsing.compare_with_next(none).count() == 0
    assert op09_simhash.near_duplicates(none).count() == 0
    assert op10_repetition.report(none).count() == 0
    assert op02_language.predict_languages(none, op02_language.learn(none)).count() == 0


def test_pipeline_stages(spark):
    docs = corpus_pipeline.documents(spark, "/root/testdata/sf0.001")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, "/root/testdata/sf0.001"), f"t-{name}")
        if name != "packing":
            assert out.columns == docs.columns and out.join(docs, "doc_id", "left_anti").count() == 0
            sizes.append(out.count())
        docs = out
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
