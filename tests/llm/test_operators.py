"""Each operator against a plain version of itself on small and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import huffman, langid, packing, pii, quality, simhash, suffixes, toxicity, warc, winnow
from ledgerline.llm.common import id_crc
from ledgerline.llm.components import connected_components
from ledgerline.llm.tokens import CachedEncoder


def same_rows(found, wanted):
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- 1 ----------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text)) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(points, radius=4):
    """Least point reachable, by comparing all."""
    root = {p: p for p in points}
    changed = True
    while changed:
        changed = False
        for a in points:
            for b in points:
                if bin(a ^ b).count("1") <= radius and root[b] < root[a]:
                    root[a] = root[b]
                    changed = True
    return root


def test_simhash(docs, empty):
    rows = pairs(docs)
    prints = {t: plain_fingerprint(t) for _, t in rows}
    root = plain_components(sorted(set(prints.values())))
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
    found = simhash.near_duplicates(docs)
    same_rows([tuple(r) for r in found.collect()], [(i, f"{prints[t]:016x}", least.get(root[prints[t]])) for i, t in rows])
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    # One id stands on texts of two groups: each keeps its own.
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(least.values()) and len(ids) == len(set(root[prints[t]] for _, t in rows))


@pytest.mark.parametrize("spread", [2, 8, 64])
def test_trees_find_every_link(spark, spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    points = set(centres.tolist())
    for _ in range(900):
        p = int(rng.choice(centres))
        for b in rng.integers(0, 62, rng.integers(0, spread)):
            p ^= 1 << int(b)
        points.add(p)
    points = sorted(points)
    edges = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in points], "fp long"), shard_rows=60, sample_rows=300)
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    wanted = plain_components(points) if len(points) < 1200 else {}
    assert {p: roots.get(p, p) for p in points} == wanted


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    root = list(range(1200))
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: r for i, r in enumerate(root) if i != r}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2 ----------------------------------------------------------------------------------------------------


def test_language(spark, empty):
    rng = random.Random(1)
    bag = {"en": "the of and to in is that for with as".split(), "de": "der die und in den von zu das mit sich".split(), "ru": "и в не на что он как это по".split()}
    text = lambda lang, n: " ".join(rng.choice(bag[lang]) for _ in range(n))
    train = [(text(lang, 60), lang) for lang in bag for _ in range(30)]
    model = langid.fit([t for t, _ in train], [lang for _, lang in train])
    cases = [(0, text("en", 30)), (1, text("de", 30)), (2, text("ru", 30)), (3, None), (4, "12 !!"), (5, ""), (6, text("en", 40) + " " + text("de", 12)), (7, text("de", 4000)), (None, text("en", 9)), (0, text("en", 30))]
    df = spark.createDataFrame(cases, "doc_id int, text string")
    rows = [r for r in langid.identify(df, model).collect()]
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(cases) and [by[i]["lang_pred"] for i in (0, 1, 2, 3, 4, 5, 7, None)] == ["en", "de", "ru", "und", "und", "und", "de", "en"]
    assert by[3]["score"] == 0 and [s["lang"] for s in by[6]["spans"]] == ["en", "de"] and 0.5 < by[6]["score"] < 1
    spans = by[6]["spans"]
    assert spans[0]["start"] == 0 and spans[-1]["stop"] == len(cases[6][1])
    assert langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit([], [])).collect()} == {"und"}


def test_pieces(texts):
    model = langid.fit(["the of and to in is", "der die und in den von"], ["en", "de"])
    plain = [t or "" for t in texts]
    whole, cut = model.scored(plain), model.scored(plain, 700)
    short = [i for i, t in enumerate(plain) if len(t) <= 700 or " " in t[:300]]
    keep = lambda s: np.isin(s.text, short)
    assert np.array_equal(whole.start[keep(whole)], cut.start[keep(cut)]) and np.allclose(whole.score[keep(whole)], cut.score[keep(cut)], atol=1e-3)


def test_viterbi_is_best_path():
    rng = np.random.default_rng(0)
    for _ in range(40):
        score = rng.normal(size=(6, 3)) * 5
        import itertools

        value = lambda path: sum(score[i, k] for i, k in enumerate(path)) - 4 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(map(value, itertools.product(range(3), repeat=6)))
        assert abs(value(langid.viterbi(score, 4.0)) - best) < 1e-9
        model = langid.LanguageModel(["a", "b", "c"], switch=4.0)
        assert abs(value(model.label(score)) - best) < 1e-9


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.pmod(id_crc("doc_id"), F.lit(5)) == 0
    model = langid.fit(*langid.labelled_sample(docs, ~held, 100))
    found = langid.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.9 * found.count()


# --- 3 ----------------------------------------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n, rep = len(words), len(inside)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


def test_quality(docs, empty):
    entries = quality.apply_policy(quality.ledger(docs))
    found = [tuple(r) for r in entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    same_rows(found, [(i, *plain_quality(t)) for i, t in pairs(docs)])
    assert entries.where("base_failed and kept").count() == 0
    rows = entries.select("failed").collect()
    for r in quality.ablations(entries).collect():
        policy = next(p for p in quality.POLICIES if (p.name, p.version) == (r["policy"], r["version"]))
        bit = quality.rule_mask((r["rule"],))
        assert r["n_kept"] == sum(not x[0] & policy.mask for x in rows)
        assert r["n_kept_without"] == sum(not x[0] & policy.mask & ~bit for x in rows)
        assert r["n_failed_alone"] == sum(x[0] & policy.mask == bit for x in rows)
    assert quality.ledger(empty).count() == 0


# --- 4 ----------------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    from tests.llm.conftest import prose

    bad = ["worthless", "disgusting", "pathetic", "scoundrel"]
    made = []
    for i in range(240):
        words = prose(rng, 60).split()
        if i % 4 == 0:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        made.append((i, " ".join(words), int(i % 4 == 0)))
    df, labels = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string"), spark.createDataFrame([(m[0], m[2]) for m in made], "doc_id long, toxic int")
    held = F.pmod(id_crc("doc_id"), F.lit(4)) == 2
    model = toxicity.fit(*toxicity.labelled_sample(df, labels, ~held, 100))
    scored = toxicity.score_toxicity(df, model).join(labels, "doc_id").where(held)
    assert scored.where("predicted <> toxic").count() <= 0.05 * scored.count()
    odd = toxicity.score_toxicity(docs, model)
    assert odd.count() == docs.count() and odd.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score_toxicity(empty, model).count() == 0
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in toxicity.score_toxicity(df, model).where("predicted = 0").collect()}
    none = toxicity.fit(["a"], [0])
    assert none.score("anything") == 0.0 and toxicity.fit([], []).score(None) == 0.0
    assert toxicity.labelled_sample(df, labels.limit(0), F.lit(True), 5) == ([], [], [])
    length = {t: len(t) for _, t, _ in made}
    some = toxicity.labelled_sample(df, labels, ~held, 100, most_chars=4_000)
    assert all(2_000 < sum(length[t] for t, y in zip(*some[:2]) if y == label) <= 4_000 for label in (0, 1))
    few = toxicity.fit(*toxicity.labelled_sample(df, labels, ~held, 40))
    assert abs(sum(few.score(m[1]) for m in made) / len(made) - 0.25) < 0.1
    assert toxicity.drop_toxic(empty, model).collect() == []
    whole = toxicity.drop_toxic(docs, model)
    assert whole.columns == docs.columns and whole.count() == toxicity.score_toxicity(docs, model).where("predicted = 0").count()


def test_toxicity_terms(spark):
    from tests.llm.conftest import prose

    rng, texts, labels = random.Random(5), [], []
    for i in range(120):
        words = prose(rng, 40).split() + (["Scoundrel,", "scoundrels!"] if i % 3 == 0 and i % 2 else []) + (["Ünwürdige"] if i % 3 == 0 else [])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    texts, labels = [*texts, "", "1 2 3"], [*labels, 0, 0]
    model = toxicity.fit(texts, labels)
    plain_words = [["".join(c for c in w if c.isalpha()) for w in t.lower().split()] for t in texts]

    def in_text(term, words):
        return any(w.startswith(term[:-1]) and len(w) >= len(term) for w in words) if term.endswith("*") else term in words

    wanted, terms = {}, {w for words in plain_words for w in words if w}
    terms |= {w[:k] + "*" for w in terms for k in range(4, 11) if len(w) > k}
    n_toxic, n_other = sum(labels), len(labels) - sum(labels)
    for term in terms:
        toxic = sum(in_text(term, w) for w, y in zip(plain_words, labels) if y)
        other = sum(in_text(term, w) for w, y in zip(plain_words, labels) if not y)
        odds = math.log((toxic + 0.5) / n_toxic / ((other + 0.5) / n_other))
        if toxic >= max(3, 0.015 * n_toxic) and odds > math.log(6):
            wanted[term] = odds
    assert model.terms == pytest.approx(wanted) and {"scoundrel", "scou*", "ünwürdige"} <= set(wanted)
    for text, words in zip(texts, plain_words):
        best = [max([v for t, v in wanted.items() if in_text(t, [w])], default=0.0) for w in words if w]
        hits = [v for v in best if v]
        plain = [math.log1p(len(hits)), math.sqrt(len(hits) / len(best)), 1.0, max(hits), math.log1p(sum(hits)), 1.0] if hits else [0.0] * 5 + [1.0]
        assert model.features(text) == pytest.approx(plain)
        x = [(a - m) / s for a, m, s in zip(plain, model.mean, model.scale)]
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-sum(a * w for a, w in zip(x, model.weights)))))


# --- 5 and 10 ---------------------------------------------------------------------------------------------

FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}


def encode_all(style, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(FILES[style]))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("style", ["word", "byte"])
def test_encoder(style, texts):
    odd = ["it's we'll 'tis don't.", "x_y.z,,w ..", "É. é, ñ!", "a b.c", "<|endoftext|> x.", "hello <|endoftext|> world", "a<|endoftext|>b.<|EndOfText|>", "<|startoftext|>, c", "<|endoftext", "<|endoftext|>", "«oui».", "…,x", "İstanbul.", "ẞ", "½,x²", " lead", "trail ", "a \n b", " ."]
    for rows in (10, 100_000):
        encoder = CachedEncoder(public_tokenizers.path(FILES[style]), style, rows)
        assert [x.tolist() for x in encoder.ids(texts + odd)] == encode_all(style, texts + odd)


def test_token_files(spark, docs, empty, tmp_path):
    encoder = CachedEncoder(public_tokenizers.path(FILES["word"]), "word")
    huffman.write_ids(docs, str(tmp_path / "ids"), encoder, 49_408, end_id=2)
    found = huffman.read_ids(spark, str(tmp_path / "ids")).collect()
    rows = pairs(docs)
    ids = {t: encode_all("word", [t])[0] + [2] for _, t in rows}
    wanted = sorted(((i, zlib.crc32(np.array(ids[t], dtype="<u4").tobytes()), len(ids[t])) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in found), key=repr) == wanted
    ordered = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1].tolist()]
    known = [r["doc_id"] for r in ordered]
    assert known == sorted(known, key=lambda i: (i is not None, i or 0))
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    huffman.write_ids(named, str(tmp_path / "named"), encoder, 49_408, end_id=2)
    by_name = [r["doc_id"] for r in huffman.read_ids(spark, str(tmp_path / "named")).orderBy("start").collect()]
    assert len(by_name) == len(rows) and by_name == sorted(by_name, key=lambda i: (i is not None, i or ""))
    one = docs.withColumn("doc_id", F.lit(7).cast("long"))
    huffman.write_ids(one, str(tmp_path / "one"), encoder, 49_408, end_id=2)
    assert huffman.read_ids(spark, str(tmp_path / "one")).agg(F.sum("n_tokens"), F.count("*"), F.count_distinct("start")).first() == (sum(map(len, (ids[t] for _, t in rows))), len(rows), len(rows))
    huffman.write_ids(empty, str(tmp_path / "none"), encoder, 49_408, end_id=2)
    assert huffman.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_huffman_code():
    rng = np.random.default_rng(1)
    for n, limit in ((1, 16), (2, 16), (300, 9), (5000, 16)):
        counts = np.zeros(n + 3, dtype=np.int64)
        counts[:n] = (rng.pareto(0.5, n) * 10 + 1).astype(np.int64)
        lengths = huffman.code_lengths(counts, limit)
        used = lengths[lengths > 0].astype(int)
        assert len(used) == n and used.max() <= limit and sum(2.0**-used) <= 1
        if n == 300:
            assert sum(2.0**-used) == 1
        docs = [rng.integers(0, n, k) for k in (0, 1, 127, 128, 129, 1000)]
        if limit == huffman.LIMIT:
            made = huffman.encode(docs, lengths, huffman.canonical_codes(lengths))
            ids = huffman._decode_block(b"".join(m[0] for m in made), np.array([len(m[0]) for m in made]), np.array([len(d) for d in docs]), np.frombuffer(b"".join(m[1] for m in made), dtype="<u4").astype(np.int64), huffman.decoding_table(lengths))
            assert ids.tolist() == np.concatenate(docs).tolist()
    assert huffman.code_lengths(np.array([1, 1, 2, 4])).tolist() == [3, 3, 2, 1]


def test_packing(spark, docs, empty):
    encoder = CachedEncoder(public_tokenizers.path(FILES["byte"]), "byte")
    rows = packing.pack_documents(docs.withColumn("doc_id", F.col("fp").cast("long")), encoder, end_id=1, capacity=256, piece=64, fine=16, windows=8, slack=3).collect()
    whole = {r["fp"]: encode_all("byte", [r["text"]])[0] + [1] for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(whole)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        assert [x for r in parts for x in np.frombuffer(r["ids"], dtype="<u4").tolist()] == whole[i]
        assert all(r["doc_tokens"] == len(whole[i]) and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"]) for r in parts)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1].tolist()]
        assert sum(r["length"] for r in parts) <= 256
    assert packing.pack_documents(empty, encoder, end_id=1).count() == 0


def test_differencing():
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 50))]
        k = rng.randint(1, 9)
        loads, windows = packing.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert loads == [sum(sizes[i] for i in w) for w in windows] == sorted(loads) and len(loads) == k
        assert all(sum(sizes[i] for i in w) <= 100 for w in packing.pack(sizes, 100))
    # The worked example of two-way differencing: 8 7 6 5 4 leaves a difference of 2.
    loads, _ = packing.differencing([4, 5, 6, 7, 8], 2)
    assert loads[1] - loads[0] == 2


# --- 6 ----------------------------------------------------------------------------------------------------


def plain_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    words, hit, names = find(text), set(), set()
    for item, t in items:
        w = find(t)
        m = min(10, len(w))
        grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
        for i in range(len(words) - m + 1):
            if grams and tuple(words[i : i + m]) in grams:
                hit.update(range(i, i + m))
                names.add(item)
    return len(words), len(hit), sorted(names - {None})


def test_winnowing(spark, docs, empty, texts, monkeypatch):
    long = next(t for t in texts if t and len(t.split()) > 100)
    w = long.split()
    items = [(1, " ".join(w[10:25])), (2, " ".join(w[40:50]).upper()), (3, "one two three"), (4, "a"), (5, None), (6, ""), (7, texts[-1][:4000]), (2, "not anywhere at all"), (8, " ".join(w[60:69]) + " changed"), (None, " ".join(w[70:82])), (9, "ab " * 12)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    wanted = [(i, *plain_hits(t, items)) for i, t in pairs(docs)]
    found = winnow.find_contamination(docs, frame)
    same_rows([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()], wanted)
    for most in (1, 64):  # a filter that passes nearly everything
        monkeypatch.setattr(winnow, "FILTER_MOST", 32 * most)
        same_rows([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in winnow.find_contamination(docs, frame).collect()], wanted)
    assert winnow.find_contamination(docs, frame.limit(0)).where("n_hit > 0").count() == 0
    assert winnow.find_contamination(empty, frame).count() == 0
    clean = winnow.drop_contaminated(docs, frame)
    assert clean.columns == docs.columns and clean.count() == sum(x[2] == 0 for x in wanted)


def test_stock_phrase(spark):
    """A phrase of nine words in all items and documents hits nothing and makes no pairs."""
    phrase = "in the event of any doubt please ask us"
    frame = lambda what, n: spark.range(n).select("id", F.concat_ws(" ", F.concat(F.lit(f"{what}a"), "id"), F.lit(phrase), F.concat(F.lit(f"{what}b"), "id")).alias("text"))
    found = winnow.find_contamination(frame("d", 3000), frame("i", 3000), "id", "text", "id", "text")
    assert found.where("n_hit > 0").count() == 0 and found.count() == 3000


# --- 7 ----------------------------------------------------------------------------------------------------


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.A.org/x/?b=2&a=1#top", 100, 200, '"e1"', None, {"Server": "s", "Date": "d1"}, 10),
        (2, "response", "https://a.org/x?a=1&b=2", 200_000, 200, '"e2"', "m", {"Date": "d2"}, 20),
        (3, "response", "https://a.org/x?a=1&b=2", 250_000, 404, '"e9"', "m", None, 30),
        (4, "revisit", "a.org/x?b=2&a=1&utm_source=q", 90_000, 304, 'W/"e1"', None, {"date": "d3", "Server": "other", "Set-Cookie": "no"}, 0),
        (5, "revisit", "https://a.org:443/x/?a=1&b=2", 300_000, 304, '"zz"', None, None, 0),
        (6, "revisit", "https://a.org/x?a=1&b=2", 100, 304, '"e1"', None, None, 0),
        (7, "revisit", "https://a.org/x?a=1&b=2", 200_001, 304, None, "m", None, 0),
        (8, "revisit", "https://a.org/x?a=1&b=2", 200_001, 304, None, None, None, 0),
        (9, "revisit", None, 200_001, 304, '"e1"', None, None, 0), (10, "revisit", "https://b.org", 5, 304, '"e1"', None, None, 0), (11, "revisit", "https://a.org/x?a=1&b=2", None, 304, '"e1"', None, None, 0),
        (13, "revisit", "http://c.org/", 9, 304, '"t"', None, {"Date": "a", "date": "b", "ETag": "c"}, 0), (14, "response", "http://c.org", 8, 200, '"t"', None, {"SERVER": "x", "Server": "y", "date": "z"}, 3),
        (12, "response", "http://a.org/x?a=1&b=2", 200_000, 200, '"e3"', "m", {"Date": "d5"}, 40), (8, "revisit", "https://a.org/x?a=1&b=2", 200_001, 304, None, None, None, 0),
    ]
    df = spark.createDataFrame(rows, "record_id long, warc_type string, url string, captured_at long, status int, etag string, last_modified string, headers map<string,string>, n_bytes long")
    for width in (10, 86_400, 10_000_000):
        got = sorted(((r["record_id"], r["response_id"], r["outcome"]) for r in warc.resolve_revisits(df, width).collect()))
        assert got == [(4, 1, "resolved"), (5, 12, "mismatch"), (6, None, "no_response"), (7, 12, "resolved"), (8, 12, "unverified"), (8, 12, "unverified"), (9, None, "no_response"), (10, None, "no_response"), (11, None, "no_response"), (13, 14, "resolved")]
    four = warc.resolve_revisits(df).where("record_id = 4").first()
    assert four["headers"] == {"server": "s", "date": "d3"} and four["n_bytes"] == 10 and four["canonical_url"] == "a.org/x?a=1&b=2"
    assert warc.resolve_revisits(df).where("record_id = 13").first()["headers"] == {"server": "y", "date": "b", "etag": "c"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    clashing = df.withColumns({c: F.lit("x") for c in ("canonical_url", "bucket", "full", "carried", "hit", "outcome", "recent", "response_id")})
    assert warc.resolve_revisits(clashing).orderBy("record_id").collect() == warc.resolve_revisits(df).orderBy("record_id").collect()


# --- 8 ----------------------------------------------------------------------------------------------------

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_identifiers(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_identifiers():
    rng = random.Random(9)
    pieces = ["a@b.c", "@", "x.y@z", ".", "1", "255", "256", "4111 1111 1111 1111", "4111-1111", "+49 (30) 123", "+", " ", "-", "é", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "9" * 15, "0001.2.3.4", "text "]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert pii.identifiers(text) == plain_identifiers(text), text


def test_personal_data(spark, docs, empty):
    rng = random.Random(6)
    from tests.llm.conftest import prose

    secret = "j.doe@mail.example"
    made = [f"{prose(rng, 20)} the zebrafish keeper wrote from {secret} today {prose(rng, 20)}" for _ in range(6)] + [prose(rng, 40) + " the today wrote from" for _ in range(60)] + [f"alone at {secret}"]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_personal_data(frame).collect()}
    marked = lambda i: {made[i][s["start"] : s["end"]] for s in found[i]["terms"]}
    assert marked(0) == {"zebrafish", "keeper"} and not marked(20) and not marked(66)
    safe = {r["doc_id"]: r["text"] for r in pii.sanitize(frame).collect()}
    assert "[EMAIL]" in safe[0] and "[TERM] [TERM]" in safe[0] and secret not in "".join(safe.values()) and safe[20] == made[20]
    rows = [(r["doc_id"], [tuple(s) for s in r["found"]]) for r in pii.find_personal_data(docs).collect()]
    same_rows(rows, [(i, plain_identifiers(t)) for i, t in pairs(docs)])
    assert pii.find_personal_data(empty).count() == 0 and pii.sanitize(empty).count() == 0
    same = pii.sanitize(docs)
    assert same.columns == docs.columns and same.count() == docs.count()


# --- 9 ----------------------------------------------------------------------------------------------------


def plain_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length,k,chunk,pairwise,crowded", [(60, 8, 1 << 20, 24, 50_000), (60, 8, 100, 2, 50_000), (60, 8, 1 << 20, 24, 3), (400, 32, 1 << 20, 24, 50_000)])
def test_repeated_strings(docs, empty, length, k, chunk, pairwise, crowded, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "PAIRWISE", pairwise)
    monkeypatch.setattr(suffixes, "RANGE_ROWS", 20)
    monkeypatch.setattr(suffixes, "RUN_ROWS", 7)
    rows = pairs(docs)
    wanted = [(i, *x) for (i, _), x in zip(rows, plain_removed([t for _, t in rows], length))]
    found = suffixes.remove_repeated(docs, length=length, k=k)
    same_rows([tuple(r)[:5] for r in found.collect()], wanted)
    assert suffixes.remove_repeated(empty, length=length, k=k).count() == 0


def test_few_texts_to_change(spark):
    """One text, or one part of one text, is all there is to remove; also with one key in the filter of texts to change."""
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(4):
        p, made = letters(500), [letters(900), letters(700)]
        texts = [f"{p}{letters(40)}{p}", made[0], made[1] + letters(3)]
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = [tuple(r)[:5] for r in suffixes.remove_repeated(frame).orderBy("doc_id").collect()]
        assert found == [(i, *x) for i, x in enumerate(plain_removed(texts, 400))] and found[0][2] == 1000
    # A part of a context is repeated in one other text alone.
    q = letters(430)
    texts = [letters(300) + q + letters(300), letters(50) + q + letters(777), letters(800)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r)[:5] for r in suffixes.remove_repeated(frame).orderBy("doc_id").collect()] == [(i, *x) for i, x in enumerate(plain_removed(texts, 400))]
    for n in (401, 300_000):
        frame = spark.createDataFrame([(0, "a" * n), (1, letters(600))], "doc_id long, text string")
        assert [tuple(r)[1:4] for r in suffixes.remove_repeated(frame).orderBy("doc_id").collect()] == [(n, n, 1), (600, 0, 0)]


def test_anchors_and_classes():
    rng = random.Random(8)
    for _ in range(30):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 300)))
        place, first, last = suffixes.anchors(data, 20, 4)
        alone = suffixes.window_anchors(data, 20, 4)
        got = [p for p, a, b in zip(place, first, last) for _ in range(a, b + 1)]
        assert got == alone.tolist()
    contexts = sorted({(bytes(rng.choice(b"xy") for _ in range(rng.randint(8, 12))), b"gram" + bytes(rng.choice(b"xy") for _ in range(rng.randint(0, 14)))) for _ in range(60)}, key=lambda c: c[1])
    lefts, rights = [c[0] for c in contexts], [c[1] for c in contexts]
    shared = [0] + [suffixes.common_prefix(a, b) for a, b in zip(rights, rights[1:])]
    spans = [(0, len(x)) for x in lefts]
    few = {i: {d for a, b in r for d in range(a, b + 1)} for i, r in enumerate(_with(suffixes, 1000, lambda: suffixes.repeated_starts(shared, lefts, rights, spans, 16)))}
    many = {i: {d for a, b in r for d in range(a, b + 1)} for i, r in enumerate(_with(suffixes, 1, lambda: suffixes.repeated_starts(shared, lefts, rights, spans, 16)))}
    window = lambda i, d: lefts[i][len(lefts[i]) - d :] + rights[i][: 16 - d] if d <= len(lefts[i]) and len(rights[i]) >= 16 - d else None
    plain = {i: {d for d in range(len(lefts[i]) + 1) if window(i, d) and any(j != i and window(j, d) == window(i, d) for j in range(len(lefts)))} for i in range(len(lefts))}
    assert few == many == plain


def _with(module, pairwise, call):
    held, module.PAIRWISE = module.PAIRWISE, pairwise
    try:
        return call()
    finally:
        module.PAIRWISE = held


def test_merging():
    rng = random.Random(7)
    for n in (0, 1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 30))) for _ in range(n)]
        coded = [suffixes.front_code(r, [b"e"] * len(r)) for r in runs]
        out = list(suffixes.merge_runs([suffixes.read_run(c) for c in coded])) if n else []
        wanted = sorted(x for r in runs for x in r)
        assert [x[1] for x in out] == wanted
        assert [x[0] for x in out[1:]] == [suffixes.common_prefix(a, b) for a, b in zip(wanted, wanted[1:])]
