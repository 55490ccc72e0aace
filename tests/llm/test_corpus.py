"""The corpus operators against brute force, exact round trips and held-out labels, on small tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.lineage import checkpoint_dir
from riskframe.llm import (components, decontaminate, embedding_forest, language_id, license_scan, line_dedup, pieces,
                           quality_rank, queries, simhash, simple8b, token_files, toxicity, word_tokens)

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, id string, w0 string, __id string"


def documents(spark, rows):
    """Rows (doc_id, text[, lang]) with columns named like those the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(30000))
    return documents(spark, [(1, None, "en"), (2, "", "en"), (3, long, "en"), (4, long, None), (4, long, None),
                             (5, "one two", "de"), (None, "one two", "de"), (6, "\n\n \n", None), (7, "12 34", "fr")])


def root_table(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_match_union_find(spark):
    draw = random.Random(4)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 540)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if x[0] != x[1]]
    assert got == root_table(real, {n for x in real for n in x})
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


# --- 1 language

def test_language_model_sums_all_segmentations():
    known = language_id.Vocabulary(PIECES)
    chance = np.random.default_rng(1).random((2, len(known.number) + 1)) / 1000
    word = "there"

    def total(rest, row):
        if not rest:
            return 1.0
        out = 0.0
        for size in range(1, len(rest) + 1):
            piece = known.number.get(rest[:size], 0 if size == 1 else None)
            if piece is not None:
                out += row[piece] * total(rest[size:], row)
        return out

    want = [np.log(total("▁" + word, row)) for row in chance]
    assert language_id.word_scores(known, chance, [word])[0] == pytest.approx(want)


def test_language_of_held_out_texts(spark):
    out = queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()


def test_language_of_odd_texts(spark, odd):
    model = language_id.fit(odd, PIECES)
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == 9 and set(rows[0].asDict()) == {*odd.columns, "lang_pred", "score"}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 6, 7}
    assert all(0 <= r.score <= 1 for r in rows)
    assert language_id.predict(odd, language_id.fit(odd.limit(0), PIECES)).where("lang_pred <> 'und'").count() == 0


def test_letters_are_no_numbers():
    assert language_id.words_of("½ ² Ⅷ 12 _ ٣ aß一x²y") == ["aß一x", "y"]
    assert all(language_id.words_of(chr(c)) == ([chr(c).lower()] if chr(c).isalpha() and chr(c).lower().isalpha() else [])
               for c in range(0x3000) if len(chr(c).lower()) == 1)


def test_rare_numbers_cost_no_time_where_there_are_none():
    """Numbers beyond the basic plane were tried one by one for every letter."""
    import re
    import time
    text = "straße und häuser " * 50_000
    plain = re.compile(r"[^\W\d_]+").findall

    def least(run):
        times = []
        for _ in range(5):
            start = time.perf_counter()
            run(text)
            times.append(time.perf_counter() - start)
        return min(times)
    assert language_id.words_of(text) == plain(text)
    assert least(language_id.words_of) < 4 * least(plain)
    assert language_id.words_of("a\U00010107b \U00011FC0 c\U0001F600d \U00010428e") == ["a", "b", "c", "d", "\U00010428e"]


def test_spans_are_all_pieces_of_a_word():
    known = language_id.Vocabulary(PIECES)
    for words in (["▁straße", "▁xq漢字\U00010428é"], ["▁a", "▁漢"], ["▁" + "internationalisation" * 3]):
        found = known.spans(words)
        assert found.shape == (len(words), len(words[0]), min(len(words[0]), known.longest))
        for w, word in enumerate(words):
            for i in range(len(word)):
                for k in range(found.shape[2]):
                    part = word[i:i + k + 1]
                    want = known.number.get(part, 0 if k == 0 else -1) if len(part) == k + 1 else -1
                    assert found[w, i, k] == want


# --- 2 lines

def lines_by_hand(rows, run):
    seen, out = set(), []
    for key, text in sorted(rows):
        lines = text.split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for s in range(len(solid) - run + 1):
            window = tuple(lines[i].strip(" ") for i in solid[s:s + run])
            if window in seen:
                gone.update(solid[s:s + run])
            seen.add(window)
        out.append((key, "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text))
    return out


@pytest.mark.parametrize("run", [2, 3, 5])
def test_line_dedup_matches_brute_force(spark, run):
    draw = random.Random(run)
    rows = [(i, "\n".join(draw.choice("abcd ") * draw.choice([1, 1, 2]) for _ in range(draw.randrange(14))))
            for i in range(60)]
    got = line_dedup.line_dedup(documents(spark, rows), run).collect()
    assert sorted((r.doc_id, r.text) for r in got) == lines_by_hand(rows, run)


def test_line_dedup_of_odd_rows(spark, odd):
    got = line_dedup.line_dedup(odd)
    assert got.columns == odd.columns and got.exceptAll(odd).count() == 0 == odd.exceptAll(got).count()
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0


# --- 3 simhash

def fingerprint_by_hand(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_meet_for_all_errors_in_reach():
    draw = np.random.default_rng(5)
    words = draw.integers(0, 1 << 63, 1500).astype(np.uint64) * 2 + draw.integers(0, 2, 1500).astype(np.uint64)
    other = words.copy()
    for i in range(len(other)):
        for bit in draw.choice(64, i % 5, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(bit)
    one, two = (set(zip(*[x.tolist() for x in simhash.exact_keys(w)])) for w in (words, other))
    assert len({row for _, row in one & two}) == len(words)


def test_simhash_classes_match_brute_force(spark, odd):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = base.unionByName(odd.where("doc_id > 0").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = df.collect()
    prints = [fingerprint_by_hand(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    group = root_table(links, range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        least[group[i]] = min(least.get(group[i], r.doc_id), r.doc_id)
    want = sorted((r.doc_id, f"{prints[i]:016x}", least[group[i]]) for i, r in enumerate(rows))
    assert sorted(map(tuple, simhash.fingerprint_classes(df).collect())) == want
    assert simhash.fingerprint_classes(df.limit(0)).count() == 0


def test_oversized_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_LIMIT", 8)
    draw = np.random.default_rng(6)
    words = {int(w) for w in draw.integers(0, 1 << 62, 20)}
    for w in list(words):
        words |= {w ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 12, (12, 2))}
    words = sorted(words)
    want = root_table([(a, b) for a in words for b in words if a < b and (a ^ b).bit_count() <= 4], words)
    got = simhash.hamming_groups(spark.createDataFrame([(w,) for w in words], "w0 long"))
    found = {r.node: r.component for r in got.collect()}
    assert {w: found.get(w, w) for w in words} == want


def test_near_duplicates_keep_one_of_each_group(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choice("abcdefghij") * draw.randrange(1, 6) for _ in range(300)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:10]):
        words = t.split()
        words[draw.randrange(300)] = "changed"
        rows += [(100 + i, t), (200 + i, " ".join(words))]
    rows += [(300, None), (301, ""), (None, texts[0])]
    kept = [r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()]
    assert sorted(k for k in kept if k is not None) == [*range(20), 300] and kept.count(None) == 1


# --- 4 embeddings

def test_embedding_classes_match_brute_force(spark):
    draw = np.random.default_rng(9)
    base = draw.standard_normal((150, 16))
    rows = [*base, *(base[:60] + 0.05 * draw.standard_normal((60, 16))), *base[:5], *(3 * base[5:8])]
    table = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(table + bad, "vec_id long, embedding array<double>").withColumn("unit", F.lit(1))
    units = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    near = units @ units.T >= 0.95
    links = [(i, j) for i, j in zip(*np.nonzero(near)) if i < j]
    group = root_table(links, range(len(rows)))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept)
           for r in embedding_forest.embedding_classes(df, leaf=32).collect()}
    assert all(got[i] == (0, i, True) for i, _ in bad)
    found = sum(got[i][0] for i in range(len(rows)))
    assert 0.95 * 2 * len(links) <= found <= 2 * len(links)
    assert all(got[i][0] <= near[i].sum() - 1 for i in range(len(rows)))
    assert np.mean([got[i][1] == group[i] for i in range(len(rows))]) >= 0.95
    assert embedding_forest.embedding_classes(df.limit(0)).count() == 0


def test_pairs_of_a_large_leaf_count_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_forest, "BLOCK", 16)
    draw = np.random.default_rng(10)
    rows = draw.standard_normal(8) * 10 + 0.01 * draw.standard_normal((90, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = embedding_forest.embedding_classes(df, leaf=20, trees=3).collect()
    assert {r.n_links for r in got} == {89} and {r.component_id for r in got} == {0}


# --- 5 benchmark

def distance_by_hand(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        before, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != x)))
    return min(row)


def test_bit_parallel_distance():
    draw = random.Random(11)
    for _ in range(500):
        p, t = ("".join(draw.choice("ab ") for _ in range(draw.randint(a, 25))) for a in (1, 0))
        assert decontaminate.best_end(decontaminate.masks(p), len(p), t)[0] == distance_by_hand(p, t)


def test_hits_match_brute_force(spark, odd):
    draw = random.Random(12)

    def prose(n):
        return " ".join("".join(draw.choice("abcd") for _ in range(draw.randint(2, 7))) for _ in range(n))

    items = [(i, prose(14)) for i in range(6)] + [(6, None), (7, " ! ")]
    rows = []
    for i in range(60):
        piece = list(draw.choice(items[:6])[1])
        for _ in range(draw.randint(0, 9)):
            at = draw.randrange(len(piece))
            piece[at:at + draw.randint(0, 1)] = draw.choice(["x", "", "Y"])
        rows.append((i, f"{prose(20).upper()}, {''.join(piece)}.\n{prose(15)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(documents(spark, rows), bench).collect()}
    want = {(i, k) for i, t in rows for k, p in items[:6] if distance_by_hand(
        decontaminate.normalise(p), decontaminate.normalise(t)) <= int(0.08 * len(decontaminate.normalise(p)))}
    assert got == want and 10 < len(want) < 60
    assert decontaminate.benchmark_hits(odd, bench).count() == 0
    assert decontaminate.benchmark_hits(odd, bench.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(documents(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(60)) - {d for d, _ in want}


# --- 6 tokens

@pytest.mark.parametrize("values", [[], [0] * 5000, [2**64 - 1, 0, 0, 1, 2**60, 2**60 - 1, 3, 0, 0], range(9000),
                                    [2**61, 0] * 700, [x * x for x in range(4000)]])
def test_simple8b_round_trip(values):
    array = np.array(values, np.uint64)
    assert (simple8b.decode(simple8b.encode(array)) == array).all()
    if len(array) > 2 * simple8b.BLOCK:
        assert (simple8b.decode(simple8b.encode(array), range(1, 2)) == array[simple8b.BLOCK:2 * simple8b.BLOCK]).all()


def test_word_tokens_are_those_of_the_library():
    draw, coder, library = random.Random(13), word_tokens.WordTokens(WORDS), Tokenizer.from_file(WORDS)
    chars = "aAbÀéßÿ'sStT0 12９½.,!?<|>\t\n\r  \x1c\x85\x0bΣσ İé́语´~^_[]’\U0001F600"
    for i in range(3000):
        text = "".join(draw.choice(chars) for _ in range(draw.randint(0, 25)))
        text += draw.choice(["", "", "<|endoftext|>", "<|ENDOFTEXT|>x"])
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_in_order_of_ids(spark, odd):
    folder = queries.scratch(spark, "test")
    token_files.write_token_files(odd, folder, WORDS)
    got = sorted((tuple(r) for r in token_files.token_digests(spark, folder).collect()), key=lambda r: r[1])
    library, start, want = Tokenizer.from_file(WORDS), 0, []
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    whole = token_files.read_token_files(spark, folder).where("id = 5").first()
    assert whole.ids == [*library.encode("one two", add_special_tokens=False).ids, 1]
    queries.discard(spark, folder)


# --- 7 licences

def test_license_statements(spark, odd):
    notice = license_scan.NOTICES[0][1]
    rows = [(1, "Foo bar.\nReleased under the MIT License.\nx"), (2, notice.replace(", and/or", ",\nand/or").upper()),
            (3, "a licence of my own\n"), (4, "text\n\n" + notice.replace("rights to use", "right to use") + "\n\nmore")]
    got = {(r.doc_id, r.scope, r["at"]): (r.license, r.dice) for r in license_scan.scan_licenses(documents(spark, rows)).collect()}
    assert got[(1, "line", 1)] == ("MIT", 1.0) and got[(2, "block", 0)] == ("MIT", 1.0)
    assert got[(4, "line", 2)][0] == "MIT" and 0.9 < got[(4, "line", 2)][1] < 1 and 3 not in {k[0] for k in got}
    assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(odd.limit(0)).count() == 0


# --- 8 pieces

@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.PieceModel(PIECES))


def test_pieces_come_back(coder):
    draw = random.Random(14)
    parts = ["a", "th", "the ", " ", "  ", "\n", "▁", "é", "中", "\U0001F600", "\t", "ing", "\x00", ".", "\n ", " \n", ",,"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert coder.decode(coder.encode(text)) == text


def test_pieces_have_the_best_score(coder):
    model = coder.model
    ids = {model.bytes_of[i].decode().replace(" ", "▁"): s for i, s in model.score.items()}

    def best(text):
        top = [0] + [None] * len(text)
        for end in range(1, len(text) + 1):
            top[end] = max([top[end - 1] + (ids[text[end - 1]] if text[end - 1] in ids else model.unknown)]
                           + [top[s] + ids[text[s:end]] for s in range(end) if text[s:end] in ids])
        return top[-1]

    for word in ("▁unbelievable", "▁the", "▁ciónmente,", "▁x☃y", "▁"):
        # the ids of a character spelt in bytes have no score of their own
        used = coder.best(word)
        spelt = sum(1 for c in word if c not in ids)
        assert sum(model.score.get(i, 0) for i in used) + spelt * model.unknown == best(word)


def test_words_of_one_length_are_coded_together(coder):
    draw = random.Random(12)
    letters = "abcdefghinorstu" * 3 + "éßñ日本𝄞½_-'1" + pieces.MARK
    words = {"".join(draw.choice(letters) for _ in range(draw.randrange(1, 12))) for _ in range(4000)}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w.encode()), []).append(w)
    for n, some in by_length.items():
        assert coder.best_of_length(some, n) == [coder.best(w) for w in some]
    texts = [" ".join(draw.choices(sorted(words), k=30)) + "\n" + "  ".join(draw.choices(sorted(words), k=5)) for _ in range(50)]
    plain = [coder.encode(t).tolist() for t in texts]
    fresh = pieces.Coder(coder.model)
    fresh.prepare(texts)
    assert [fresh.encode(t).tolist() for t in texts] == plain and all(fresh.decode(np.array(i)) == t for i, t in zip(plain, texts))


def test_pieces_of_odd_rows(spark, odd):
    rows = pieces.encode_pieces(odd, PIECES).collect()
    assert len(rows) == 9 and all(r.decoded == (r.text or "") for r in rows)
    assert pieces.encode_pieces(odd.limit(0), PIECES).count() == 0


# --- 9 and 10 classifiers

@pytest.mark.parametrize("name, label, least", [("op9_toxicity", "toxic", 0.9), ("op10_quality_rank", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    assert got.where(F.col(label) == F.col("predicted")).count() >= least * got.count()


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (3, 0, 0), (5, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        got = toxicity.toxicity(odd, table, F.lit(True))
        assert got.count() == 9 and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
        model = quality_rank.fit(odd.join(table.dropDuplicates(["doc_id"]), "doc_id"))
        got = quality_rank.rank(odd, model)
        assert got.count() == 9 and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_quality_weights_are_those_of_all_pairs_of_all_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        good = rng.random() < 0.6
        words = [rng.choice(["alpha", "beta", "gamma.", "DELTA", "7", "|"][:3 if good and rng.random() < 0.7 else 6]) for _ in range(rng.randint(3, 60))]
        rows.append((" ".join(words), int(good)))
    model = quality_rank.fit(spark.createDataFrame([*rows, ("none", None)], "text string, quality int").repartition(3))
    x, y = np.array([quality_rank.features(t) for t, _ in rows]), np.array([q for _, q in rows])
    scale = x.std(0)
    scale[scale < 1e-9] = 1.0
    z = (x - x.mean(0)) / scale
    gap = (z[y == 1][:, None] - z[y == 0]).reshape(-1, z.shape[1])
    weights = np.zeros(z.shape[1])
    for _ in range(30):
        wrong = 1 / (1 + np.exp(gap @ weights))
        bend = (gap * (wrong * (1 - wrong))[:, None]).T @ gap / len(gap) + quality_rank.PENALTY * np.eye(len(weights))
        weights = weights + np.linalg.solve(bend, gap.T @ wrong / len(gap) - quality_rank.PENALTY * weights)
    assert model.weights == pytest.approx(weights, abs=2e-3)
    raw = np.sort(z @ model.weights)
    assert model.cut == pytest.approx(raw[(y == 0).sum() - 1:][:2].mean(), abs=1e-9)
    assert model.spread == pytest.approx(max(1.0, raw.std()))


# --- the pipeline

def test_pipeline_stages_on_small_tables(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        folder = queries.scratch(spark, "stage")
        after.write.parquet(folder)
        before, docs = docs, spark.read.parquet(folder)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("NOT restored").count() == 0
    clean = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.benchmark_hits(docs, clean).count() == 0


def test_pipeline_on_odd_rows(spark, odd):
    import corpus_pipeline
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert checkpoint_dir(spark)
