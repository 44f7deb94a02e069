"""Each operator against brute force, a round trip or held-out accuracy, on tables with
nulls, empty and long texts, ties, repeated rows and columns whose names clash."""

import datetime as dt
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from quarry.llm import (chat_format, cws, dac_codes, decontaminate, language_id, packing, parity_join, pii,
                        quality_mil, substring_dedup)
from quarry.llm.scratch import written

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORDS = [a + b for a in "ba de ki lo mu".split() for b in "n r st th x".split()]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(n))


def near(s, seed, edits):
    w, r = s.split(" "), random.Random(seed)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randint(0, 10 ** 6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    base = text(1, 120)
    out = [(1, base), (2, base), (3, near(base, 1, 2)), (4, None), (5, ""), (6, " \t\n"), (7, "One Two"),
           (8, "one two"), (9, text(2, 6000)), (10, text(3, 300)), (11, text(4, 40) + "\n" + base[:400]),
           (12, near(text(2, 6000), 5, 150)), (13, "ünï ÇÖDÉ é. 日本語 text"), (14, text(6, 70)),
           (15, near(text(6, 70), 8, 1)), (None, base), (None, None)]
    return out + [(20 + i, near(base, 100 + i, i % 5)) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # names that the operators use inside
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in
                            ("key", "body", "component", "n", "lang", "hub", "signature", "word", "head", "source")])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pseudonymise(s, key=pii.TRIAL_KEY, back=False):
    return pii.pseudonymise(s, key, back)


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def test_fingerprints_estimate_generalised_jaccard(spark, docs, empty, rows):
    got = {r.doc_id: r for r in cws.compare_with_edits(docs).collect()}
    own = sorted(((k, s or "") for k, s in rows if k is not None), reverse=True)
    assert set(got) == {k for k, _ in own}
    errors = []
    for i, (k, s) in enumerate(own):
        following = own[(i + 1) % len(own)][1]
        edited = s[:len(s) - len(s) // 3] + following[:len(s) // 3]
        assert got[k].n_chars == len(s)
        assert got[k].edited_sha256 == duckdb.execute("SELECT sha256(?)", [edited]).fetchall()[0][0]
        for other, near_value in ((edited, got[k].near_edited), (following, got[k].near_next)):
            a, b = Counter(words(s)), Counter(words(other))
            most = sum((a | b).values())
            errors.append(near_value - (sum((a & b).values()) / most if most else 1.0))
    assert abs(np.mean(errors)) < 0.05 and np.max(np.abs(errors)) < 0.4
    assert got[1].fingerprint == got[2].fingerprint and got[4].fingerprint == ""
    assert cws.compare_with_edits(empty).count() == 0
    lone = spark.createDataFrame([(3, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert [r.near_next for r in cws.compare_with_edits(lone).collect()] == [1.0]


def shingles(s):
    w = words(fold(s))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_against_all_pairs(docs, empty, rows):
    sets = {k: shingles(s) for k, s in rows if k is not None}
    least = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    least[a] = least[b] = min(least[a], least[b])
    got = parity_join.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == least
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {k: len(s) for k, s in sets.items()}
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert parity_join.near_duplicates(docs.union(docs.filter("doc_id = 1"))).filter("doc_id = 1").count() == 1
    kept = parity_join.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(least.values()) | {None}
    assert parity_join.near_duplicates(empty).count() == 0 and parity_join.keep_first(empty).count() == 0


def test_signatures_leave_enough_blocks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 47, 48, 63, 64, 100, 192, 255, 256, 700, 768, 1023, 1024, 5000):
        for _ in range(20):
            s = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            found = parity_join.block_signatures(s, np.zeros(n, bool))
            assert len(found) == len(parity_join._bands(n, parity_join.THRESHOLD)) * (n // 3 + 1)


def test_sketch_distance_bounds_the_difference():
    rng = np.random.default_rng(2)
    a, b, c = (rng.integers(0, 1 << 62, 300, dtype=np.uint64) for _ in range(3))
    x, y = np.concatenate([a, b]), np.concatenate([a, c])
    apart = np.bitwise_count((parity_join.parity_sketch(x) ^ parity_join.parity_sketch(y)).view(np.uint64)).sum()
    assert 0 < apart <= 600


def test_sketches_of_two_lengths_and_the_key_bitmap(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 62, 600, dtype=np.uint64)
    y = np.concatenate([x[:480], rng.integers(0, 1 << 62, 20, dtype=np.uint64)])
    a, b = parity_join.parity_sketch(x), parity_join.parity_sketch(y)
    assert (len(a), len(b)) == (32, 16)
    pairs = spark.createDataFrame([((a.tolist(),), (b.tolist(),)), ((b.tolist(),), (a.tolist(),))],
                                  "fa struct<sketch array<bigint>>, fb struct<sketch array<bigint>>")
    apart = [r.d for r in pairs.select(parity_join._distance().alias("d")).collect()]
    assert apart[0] == apart[1] and 0 < apart[0] <= 140
    keys = [-(1 << 63), -7, 0, 5, (1 << 63) - 1]
    docs = spark.createDataFrame([(k, "a b c d e f") for k in [*keys, 6]], "key bigint, body string")
    wanted = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert {r.doc_id for r in parity_join.sets_of(docs, wanted).collect()} >= set(keys)
    assert parity_join.sets_of(docs, wanted.limit(0)).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def linked_with(sets):
    """The least key reachable by links, by comparing all pairs."""
    least = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and jaccard(sets[a], sets[b]) >= 0.75]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least, links


def test_strangers_on_one_template_form_no_pairs(spark, monkeypatch):
    """Documents that share 0.54 of a template and nothing else, among them a few that are linked."""
    rng = random.Random(31)
    template = text("template", 75)
    made = {i: f"{template} {text(f'own{i}', 31)}" for i in range(1, 301)}
    for i in range(301, 321):
        made[i] = f"{template} {text(f'own{rng.randint(1, 300)}', 29)} {text(f'tail{i}', rng.randint(1, 4))}"
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(7)
    formed = []
    real = parity_join.pairs_apart
    monkeypatch.setattr(parity_join, "pairs_apart", lambda d, m: formed.append((d, m)) or real(d, m))
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(docs).collect()}
    want, links = linked_with({i: set(shingles(s)) for i, s in made.items()})
    assert got == want and any(want[i] != i for i in want)
    members = spark.createDataFrame([(i, i) for i in made], "doc_id long, component long")
    keyed = docs.select(docs.doc_id.alias("key"), docs.text.alias("body"))
    pairs = {(r.a, r.b) for r in real(keyed, members).collect()}
    assert set(links) <= pairs and len(pairs) < 3 * len(made)


def test_copies_whose_first_document_is_no_link(spark):
    """Every block of the copies is one of a longer document with the least key."""
    short, more = text("short", 40), text("more", 20)
    made = {1: f"{short} {more}", **{i: short for i in range(2, 120)}, 200: text("else", 50), 201: None, 202: ""}
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(docs).collect()}
    want = {**{i: 2 for i in range(2, 120)}, **{i: i for i in (1, 200, 201, 202)}}
    assert got == want


@pytest.mark.parametrize("share", [0.02, 0.1, 0.2])
def test_every_link_among_members_is_a_candidate(spark, share):
    rng = random.Random(share)
    base = text("base", 90).split()
    made = {}
    for i in range(60):
        own = [w if rng.random() > share / 2 else f"x{i}y{rng.randint(0, 9)}" for w in base]
        made[i] = " ".join(own[:rng.randint(55, 90)])
    docs = spark.createDataFrame(list(made.items()), "key long, body string")
    members = spark.createDataFrame([(i, i) for i in made], "doc_id long, component long")
    _, links = linked_with({i: set(shingles(s)) for i, s in made.items()})
    assert set(links) <= {(r.a, r.b) for r in parity_join.pairs_apart(docs, members).collect()}


def test_repeated_windows_against_brute_force(docs, empty, rows):
    first = {}
    for k, s in rows:
        w = words(s)
        for i in range(len(w) - 12 if k is not None else 0):
            t = tuple(w[i:i + 13])
            first[t] = min(first.get(t, k), k)
    want = {}
    for k, s in rows:
        w, gone = words(s), set()
        for i in range(len(w) - 12 if k is not None else 0):
            if first[tuple(w[i:i + 13])] < k:
                gone |= set(range(i, i + 13))
        want.setdefault(k, []).append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = {}
    for r in substring_dedup.remove_repeats(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_text))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_languages(spark, docs, empty):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(table)
    r = language_id.identify(table, model).join(table, "doc_id").filter(language_id.held_out(F.col("doc_id")))
    assert r.filter("lang_pred = lang").count() >= 0.97 * r.count() > 0
    got = {x.doc_id: x for x in language_id.identify(docs, model).collect() if x.doc_id is not None}
    assert all(got[k].lang_pred == "und" and got[k].rejected and got[k].score == 0 for k in (4, 5, 6))
    assert got[13].rejected and 0 < got[13].score <= 1
    assert language_id.identify(empty, model).count() == 0
    none = language_id.train(docs)  # no row names a language
    assert {x.lang_pred for x in language_id.identify(docs, none).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    model = language_id.KneserNey(Counter("\2\2\2a \2\2ab \2ab\3 \2\2ac \2ac\3 \2\2\2b \2\2b\3".split(" ")))
    letters = sorted(model.counts[1])
    for context in ("", "\2", "a", "\2a", "\2\2a", "\2\2\2", "zz"):
        total = sum(model.probability(context + c, len(letters) + 1) for c in letters)
        assert total == pytest.approx(1 - model.probability(context + "?", len(letters) + 1), abs=1e-9)


def test_chat_round_trip_and_edges(spark):
    odd = r"a\[INST]<s></s>\\<[/INST]|<\[\ "
    data = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "user", None), (2, 1, "assistant", "b"),
            (2, 0, "system", ""), (2, 1, "assistant", "b"), (3, 0, None, "x\n\n"), (None, None, "assistant", "n")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("head", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(written(chat_format.expand(turns), "t")).collect()}
    for k in (1, 2, 3, None):
        own = sorted((r[1] or 0, r[2] or "", r[3] or "") for r in data if r[0] == k)
        whole = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        sha = lambda s: duckdb.execute("SELECT sha256(?)", [s]).fetchall()[0][0]
        assert (got[k].n_turns, got[k].turns_sha256) == (len(own), sha(whole))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha(loss))
    example = chat_format.expand(turns).filter("conv_id = 1").select("formatted").first()[0]
    assert example.count("</s>") == example.count("<s>")
    assert chat_format.read_back(chat_format.expand(turns.limit(0))).count() == 0


def streams(rows, end):
    t = Tokenizer.from_file(VOCABULARY)
    return [(k, np.array(t.encode(s or "", add_special_tokens=False).ids + [end], "<u4")) for k, s in rows]


def test_packing_covers_every_id_once(docs, empty, rows):
    pieces = packing.pack(docs, VOCABULARY, 1, with_ids=True, block_ids=20_000).toPandas()
    for k, ids in streams(rows, 1):
        if k is None:
            continue
        own = pieces[pieces.doc_id == k].sort_values("start")
        assert (own.start.to_numpy() == np.cumsum(own.length) - own.length).all()
        assert b"".join(own.ids) == ids.tobytes() and set(own.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(x) == c for x, c in zip(own.ids, own.ids_crc32))
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= s.tier.iloc[0]
    assert packing.pack(empty, VOCABULARY, 1).count() == 0


def test_only_one_window_stays_open():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.choice([1, 5, 200, 256, 900, 2048, 5000]) + rng.randint(0, 300) for _ in range(rng.randint(1, 60))]
        windows = packing.plan_windows(lengths)
        assert sum(n for _, w in windows for _, _, n in w) == sum(lengths)
        assert sum(sum(n for _, _, n in w) != t for t, w in windows) <= 1


def test_codes_round_trip_and_random_access(docs, empty, rows):
    rng = np.random.default_rng(4)
    for ids in (np.zeros(0, np.uint32), rng.integers(0, 1 << 32, 3000, dtype=np.uint32),
                rng.integers(0, 300, 5000).astype(np.uint32), np.array([255, 256, 65535, 65536], np.uint32)):
        reader = dac_codes.DacReader(dac_codes.dac_encode(ids))
        assert len(reader) == len(ids) and (reader.slice(0, len(ids)) == ids).all()
        for i in rng.integers(0, max(1, len(ids)), 50 if len(ids) else 0):
            assert reader[int(i)] == ids[i]
        for a, b in rng.integers(0, len(ids) + 1, (20, 2)):
            assert (reader.slice(min(a, b), max(a, b)) == ids[min(a, b):max(a, b)]).all()
    blocks = written(dac_codes.token_blocks(docs, VOCABULARY, 2, block_ids=500), "blocks")
    got = sorted(((r.start, r.n_tokens, r.ids_crc32), r.doc_id) for r in dac_codes.read_documents(blocks).collect())
    want = sorted(streams(rows, 2), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    at = 0
    for ((start, n, crc), k), (key, ids) in zip(got, want, strict=True):
        assert (start, n, crc, k) == (at, len(ids), zlib.crc32(ids.tobytes()), key)
        at += n
    assert dac_codes.read_documents(dac_codes.token_blocks(empty, VOCABULARY, 2)).count() == 0


def test_leaks_are_found_and_strangers_left(spark, docs, empty):
    items = [(1, text(50, 30)), (2, text(51, 59)), (3, None), (4, ""), (5, "just three words"), (6, text(52, 15))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    planted = [(100, text(60, 400) + " " + items[0][1].upper() + " " + text(61, 300)), (101, near(items[1][1], 3, 1)),
               (102, " ".join(items[1][1].split()[:20]) + " " + text(62, 200)), (103, "x " + items[4][1] + " y"),
               (104, items[5][1] + "\n" + items[0][1])]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()}
    assert got == {(100, 1), (101, 2), (103, 5), (104, 6), (104, 1)}
    kept = decontaminate.without_leaks(table, bench)
    assert kept.columns == table.columns and kept.count() == table.count() - 4
    assert decontaminate.leaks(empty, bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_pseudonyms_keep_formats_and_go_back(docs, empty):
    s = ("card 4111 1111 1111 1111, not 4111 1111 1111 1112; +1 (017) 555-7713 a.b-c9@mail.example.com "
         "10.200.3.4 not 300.1.1.1 born 1984-02-29 not 1985-02-29, 31/12/1999 03.04.2011 078-05-1120 "
         "GB82WEST12345698765432 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"")
    out, n = pseudonymise(s)
    assert n == 10 and len(re.findall(r"4111 1111 1111 1112|300\.1\.1\.1|1985-02-29", out)) == 3
    assert pseudonymise(out, back=True) == (s, 10) and pseudonymise(s)[0] == out
    assert pseudonymise(s, key=b"another")[0] != out
    shape = lambda x: re.sub("[a-z]", "a", re.sub(r"\d", "9", x))
    card = re.search(r"card ([\d ]+),", out).group(1).replace(" ", "")
    assert pii.luhn_digit(card[:-1]) == card[-1] and shape(out[:27]) == shape(s[:27])
    dt.date.fromisoformat(re.search(r"born (\S+)", out).group(1))
    for size in (2, 3, 10, 97, 1000):
        image = [pii.feistel(x, size, b"k", "t") for x in range(size)]
        assert sorted(image) == list(range(size))
        assert [pii.feistel(y, size, b"k", "t", back=True) for y in image] == list(range(size))
    done = pii.pseudonyms(docs, pii.TRIAL_KEY, count="found")
    assert done.columns == docs.columns + ["found"] and done.count() == docs.count()
    assert done.filter("doc_id = 4").first().text is None and pii.pseudonyms(empty, pii.TRIAL_KEY).count() == 0
    with pytest.raises(ValueError):
        pii.pseudonyms(docs, pii.TRIAL_KEY, count="key")


def test_quality(spark, docs, empty):
    table, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_mil.train(table, labels)
    r = quality_mil.quality(table, model).join(labels, "doc_id").filter(quality_mil.held_out(F.col("doc_id")))
    assert r.filter("predicted = quality").count() >= 0.95 * r.count() > 0
    got = quality_mil.quality(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= x.score <= 1 for x in got)
    assert quality_mil.quality(empty, model).count() == quality_mil.accepted(empty, model).count() == 0
    even = quality_mil.train(docs, labels.limit(0))
    assert {x.score for x in quality_mil.quality(docs, even).collect()} == {0.5}


def test_attention_gradients():
    rng = np.random.default_rng(5)
    model = quality_mil.fit([rng.normal(size=(3, quality_mil.FEATURES)) for _ in range(4)], np.array([0, 1, 0, 1]))
    x, limits = rng.normal(size=(7, quality_mil.FEATURES)), np.array([0, 3, 4, 7])
    y, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := model.score(x, limits), 1 - p)))
    for name, g in model.gradients(x, limits, y, weight).items():
        at = np.unravel_index(np.argmax(np.abs(g)), np.shape(g))
        kept = np.array(model.weights[name], float)
        values = []
        for step in (1e-5, -1e-5):
            moved = kept.copy()
            moved[at] += step
            model.weights[name] = moved
            values.append(loss())
        model.weights[name] = kept
        assert (values[0] - values[1]) / 2e-5 == pytest.approx(float(np.asarray(g)[at]), rel=1e-3, abs=1e-7)


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        after = written(stage(spark, table, SMALL), f"stage-{name}")
        assert after.columns == table.columns and 0.7 * table.count() <= after.count() <= table.count()
        assert stage(spark, table.limit(0), SMALL).count() == 0
        table = after
    packed = P.STAGES[-1][1](spark, table, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in table.collect()}


def test_every_operator_is_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_hot_windows_are_marked_like_others(spark):
    rows = [(7, d) for d in range(400)] + [(100 + d // 2, d) for d in range(800)] + [(9, 5)] * 300
    found = spark.createDataFrame(rows, "window bigint, doc_id bigint")
    least = {}
    for w, d in rows:
        least[w] = min(d, least.get(w, d))
    got = [(r.doc_id, r.window) for r in substring_dedup.later_windows(found).collect()]
    assert sorted(got) == sorted((d, w) for w, d in rows if d > least[w])


def test_long_items_with_an_edited_run_are_found():
    """Against brute force: one run of words of an item replaced, as long as 0.75 allows."""
    rng = random.Random(11)
    item_words = {n: text(1000 + n, n).split() for n in (60, 127, 128, 200, 300, 400, 500)}
    index = decontaminate.ItemIndex([(n, " ".join(w)) for n, w in item_words.items()])
    missed = []
    for n, w in item_words.items():
        grams = lambda x: Counter(tuple(x[i:i + 5]) for i in range(len(x) - 4))
        for trial in range(20):
            run = n // 7 - 6
            at = 0 if trial % 2 else rng.randrange(n - run + 1)
            edited = w[:at] + [f"new{rng.randint(0, 10 ** 6)}" for _ in range(run)] + w[at + run:]
            a, b = grams(w), grams(edited)
            similarity = sum((a & b).values()) / sum((a | b).values())
            assert similarity >= 0.75
            body = " ".join(text(rng.random(), rng.randint(0, 300)).split() + edited + text(rng.random(), 200).split())
            raw = np.frombuffer(body.encode(), np.uint8)
            got = {index.ids[i]: s for _, i, _, s in index.matches(decontaminate.A.Chunk(0, raw, np.array([0, len(raw)])))}
            if set(got) != {n} or got[n] < similarity - 1e-9:
                missed.append((n, at, got))
    assert not missed
    item, body = "a b c d e a b c d e f g", "x a b c d e a b c d e a b c d e a b c d e f g"
    index = decontaminate.ItemIndex([(1, item)])
    raw = np.frombuffer(body.encode(), np.uint8)
    assert index.matches(decontaminate.A.Chunk(0, raw, np.array([0, len(raw)]))) == [(0, 0, 11, 1.0)]


def test_numbers_beside_numbers_are_replaced():
    card = pseudonymise("4111 1111 1111 1111")[0]
    plain, phone, iban = card.replace(" ", ""), pseudonymise("555-123-4567")[0], pseudonymise("GB82WEST12345698765432")[0]
    printed = " ".join(iban[i:i + 4] for i in range(0, len(iban), 4))
    number = "4111 1111 1111 1111"
    for before in ("", "12 ", "7 ", "26 123 "):
        for after in ("", " 12/26", " 123", " 12", " 1 2 3", "-123", " 2024"):
            out, n = pseudonymise(f"{before}{number}{after}.")
            assert (out, n) == (f"{before}{card}{after}.", 1)
    assert pseudonymise("4111111111111111 123")[0] == f"{plain} 123"
    assert pseudonymise(f"{number} {number}")[0] == f"{card} {card}"
    assert pseudonymise("12-4111-1111-1111-1111-9")[0] == "12-" + card.replace(" ", "-") + "-9"
    assert pseudonymise("555-123-4567 123 items")[0] == f"{phone} 123 items"
    assert pseudonymise(f"555-123-4567 {number}")[0] == f"{phone} {card}"
    for after in ("", " 12", " 2024", " AND 7", "."):
        s = f"to GB82 WEST 1234 5698 7654 32{after}"
        assert pseudonymise(s) == (f"to {printed}{after}", 1)
        assert pseudonymise(f"to {printed}{after}", back=True) == (s, 1)
    es = "ES91 2100 0418 4502 0005 1332"
    out = pseudonymise(es)[0]
    assert out != es and pseudonymise(f"{es} 2024 AB 1")[0] == f"{out} 2024 AB 1"
    # a card in unusual groups, between numbers
    assert pseudonymise("41111 11111 11111 1")[1] == 1
    many = " ".join(["1"] * 50_000)
    assert pseudonymise(many) == (many, 0)


def test_language_model_holds_every_gram(spark):
    """Against Kneser-Ney in plain Python, with more 4-grams than once were kept."""
    letters = [chr(0x4E00 + i) for i in range(600)]
    rng = random.Random(7)
    table = [(i, "xx", "".join(rng.choice(letters) for _ in range(2000))) for i in range(250)]
    table += [(1000 + i, "yy", text(i, 30)) for i in range(20)]
    docs = spark.createDataFrame(table, "doc_id long, lang string, text string")
    model = language_id.train(docs)
    held = {r.doc_id for r in docs.filter(language_id.held_out(F.col("doc_id"))).collect()}
    counts = {"xx": Counter(), "yy": Counter()}
    for k, lang, body in table:
        for w in re.findall(r"[^\W\d_]+", body) if k not in held else []:
            framed = "\2\2\2" + w + "\3"
            counts[lang].update(framed[i:i + 4] for i in range(len(w) + 1))
    assert len(counts["xx"]) > 200_000
    exact = [language_id.KneserNey(counts[x]) for x in ("xx", "yy")]
    alphabet = len({g for m in exact for g in m.counts[1]}) + 1
    some = rng.sample(sorted(counts["xx"]), 200) + sorted(counts["yy"])[:200] + ["\2\2\2q", "zqzq", "\2\2\2" + letters[0]]
    codes = np.array([[ord(c) for c in g] for g in some], np.int64)
    hi, lo = codes[:, 0] << 21 | codes[:, 1], codes[:, 2] << 21 | codes[:, 3]
    arrays = model.block(0)
    assert model.blocks == 1 and len(arrays[0][4][0]) == len(counts["xx"])
    for lang, m in enumerate(exact):
        assert all((np.diff(h.astype(object)) > 0).all() for h, _ in arrays[lang].values())
        assert np.exp(model.score(arrays[lang], lang, hi, lo)) == pytest.approx(
            [m.probability(g, alphabet) for g in some], rel=1e-9)


@pytest.mark.parametrize("block_bytes", [64 << 20, 4000])
def test_texts_cross_entropies_by_definition(spark, docs, block_bytes):
    """Whole texts, nulls, repeated rows and rows without a key, with one block and with many."""
    table = [(i, x, text(i + 50 * j, 20)) for j, x in enumerate(("aa", "bb", None)) for i in range(12)]
    train = spark.createDataFrame(table, "key long, own string, body string")
    counts = {"aa": Counter(), "bb": Counter()}

    def framed(body):
        return ["\2\2\2" + w.lower() + "\3" for w in re.findall(r"[^\W\d_]+", body or "")]

    for _, lang, body in table:
        for w in framed(body) if lang else []:
            counts[lang].update(w[i:i + 4] for i in range(len(w) - 3))
    exact = [language_id.KneserNey(counts[x]) for x in ("aa", "bb")]
    alphabet = len({g for m in exact for g in m.counts[1]}) + 1
    model = language_id.count_model(language_id.gram_rows(train), block_bytes)
    assert (model.blocks > 2) == (block_bytes == 4000)
    rows = docs.select(F.col("doc_id").alias("key"), F.lit(None).cast("string").alias("own"), F.col("text").alias("body"))
    rows = rows.union(rows.filter("key < 5"))
    got = Counter((r.key, tuple(round(x, 9) for x in r.entropies) if r.entropies else None)
                  for r in language_id.cross_entropies(rows, model).collect())
    want = Counter()
    for key, _, body in rows.collect():
        grams = [w[i:i + 4] for w in framed(body) for i in range(len(w) - 3)]
        want[key, tuple(round(-sum(np.log(m.probability(g, alphabet)) for g in grams) / len(grams), 9)
                        for m in exact) if grams else None] += 1
    assert got == want


def test_rejection_limits_come_from_all_training_texts_of_a_language(spark):
    rows = [(i, "xx", "aba bab abba " * 2) for i in range(6000)] + [(6000 + i, "yy", text(i, 1 + i % 9)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(docs)
    found = language_id.identify(docs, model).join(docs, "doc_id").filter(~language_id.held_out(F.col("doc_id")))
    own = [r.cross_entropy for r in found.filter("lang = 'yy' and lang_pred = 'yy'").collect()]
    assert len(own) == found.filter("lang = 'yy'").count() > 20
    assert model.limits[1] == pytest.approx(1.1 * np.quantile(own, language_id.REJECT_QUANTILE), rel=1e-9)
    assert found.filter("lang = 'yy' and rejected").count() == 0
    noise = spark.createDataFrame([(1, "qqq zzz jjj vvv yyy www")], "doc_id long, text string")
    assert language_id.identify(noise, model).first().rejected
    assert sorted(language_id.train_and_identify(docs).collect()) == sorted(language_id.identify(docs, model).collect())


def test_step_groups_are_even_over_all_tasks(spark):
    rows = [(i, text(i, 50 + i % 400)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    pieces = packing.pack(docs, VOCABULARY, 1, step_tokens=4096).toPandas()
    windows = pieces.drop_duplicates("sequence_id")
    assert (windows.sequence_id // 2 ** 32).nunique() == 6
    for tier, own in windows.groupby("tier"):
        groups = own.groupby("step_group").size().sort_index()
        assert list(groups.index) == list(range(len(groups)))
        assert (groups.iloc[:-1] * tier == 4096).all() and groups.iloc[-1] * tier <= 4096


def mails():
    return {n: "".join(random.Random(n).choices("abcdefghij", k=n)) + "@example.org" for n in (1, 30, 63, 64, 65, 220, 5000)}


def test_local_parts_of_any_length(spark):
    given = mails()
    table = spark.createDataFrame([(n, f"to {m}, from {m}") for n, m in given.items()], "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n) for r in pii.pseudonyms(table, b"secret", count="n").collect()}
    for n, m in given.items():
        new = found[n][0].split(" ")[1].rstrip(",")
        assert found[n] == (f"to {new}, from {new}", 2)
        assert (new == m) <= (n == 1) and len(new) == len(m) and new.endswith("@example.org") and new[:n].islower()
        assert pseudonymise(found[n][0], b"secret", back=True)[0] == f"to {m}, from {m}"
    assert pseudonymise("%" * 200_000 + "x" * 200_000)[1] == 0


def test_table_of_every_format(spark):
    """Each value by definition: the Feistel image of its number in its format's domain, one to
    one, the same in every document, validated, and undone with the key."""
    r = random.Random(11)
    made = {
        "date": [f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" for _ in range(60)],
        "card": [b + pii.luhn_digit(b) for b in (f"4{r.randrange(10 ** 14):014d}" for _ in range(60))],
        "ip": [".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(60)],
        "social": [f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" for _ in range(60)],
        "phone": [f"{r.randrange(1000):03d}-{r.randrange(1000):03d}-{r.randrange(10000):04d}" for _ in range(60)],
        "secret": [f"{r.getrandbits(128):032x}" for _ in range(60)]}
    plain = [(f"{kind}{i % 2}", v) for kind, vs in made.items() for i, v in enumerate(vs + vs[:5])]
    table = spark.createDataFrame([(k, f"<{v}>") for k, v in plain], "kind string, text string")
    rows = pii.pseudonyms(table, b"k", count="n").collect()
    assert all(x.n == 1 for x in rows)
    image = {}
    for kind, value in plain:
        x = pii.pseudonymise(f"<{value}>", b"k")[0][1:-1]
        assert image.setdefault(value, x) == x
        assert re.sub("[0-9a-f]", "0", x) == re.sub("[0-9a-f]", "0", value) or kind.startswith("ip")
        assert pii.pseudonymise(f"<{x}>", b"k", back=True) == (f"<{value}>", 1)
    assert Counter(x.text for x in rows) == Counter(f"<{image[v]}>" for _, v in plain)
    assert len(set(image.values())) == len(image)
    for value in made["card"]:
        assert pii.luhn_digit(image[value][:-1]) == image[value][-1]
        assert int(image[value][:-1]) == pii.feistel(int(value[:-1]), 10 ** 15, b"k", "card")
    first = dt.date(1900, 1, 1)
    for value in made["date"]:
        day = dt.date.fromisoformat(value)
        assert dt.date.fromisoformat(image[value]) == first + dt.timedelta(
            pii.feistel((day - first).days, (dt.date(2099, 12, 31) - first).days + 1, b"k", "dateymd"))
    for value in made["phone"]:
        number = int(value.replace("-", ""))
        assert int(image[value].replace("-", "")) == pii.feistel(number, 10 ** 10, b"k", "phone")


def test_candidates_are_bounded_before_their_shingles_are_compared(monkeypatch):
    """Only stretches that hold enough shingles of any item are compared shingle by shingle, and the
    bound keeps every stretch that has enough in common."""
    import numpy as np
    from quarry.llm import arrays as A, decontaminate as dc
    items = [(i, " ".join(f"item{i}w{j}" for j in range(20 + 3 * i))) for i in range(8)]
    index = dc.ItemIndex(items + [(8, "two words")])
    texts = [" ".join(f"plain{k}x{j}" for j in range(400)) for k in range(20)] + [
        " ".join([f"a{i}"] * i + t.split()[:len(t.split()) - i // 2]) for i, t in items]
    raw = [t.encode() for t in texts]
    chunk = A.Chunk(0, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    words, hashes = dc._word_hashes(chunk)
    grams = A.shingle_hashes(hashes, np.array([0, len(hashes)]), dc.SHINGLE)[0]
    rows, item = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(9), indexing="ij"))
    start, slack = words.row_first[rows], np.full(len(rows), 5)
    compared, real = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **k: compared.append(np.size(v)) or real(a, v, *x, **k))
    got = index._enough_in_common(grams, words.row_first, rows, item, start, slack)
    monkeypatch.undo()
    assert sum(compared) < 2000  # all stretches hold 8,000 words and more
    for k, (row, i) in enumerate(zip(rows.tolist(), item.tolist())):
        lo, hi = words.row_first[row], min(words.row_first[row + 1], words.row_first[row] + 5 + index.lengths[i])
        own = set(index.shingles[i].tolist())
        hits = sum(g in own for g in grams[lo:hi - dc.SHINGLE + 1].tolist())
        assert got[k] == (index.lengths[i] < 5 or hits >= 0.75 * (index.lengths[i] - 4)), (row, i)
    assert 8 <= got[rows >= 20].sum() and not got[(rows < 20) & (item < 8)].any()


def test_near_copies_of_one_text_meet_hubs_before_each_other(spark, monkeypatch):
    """Hundreds of near copies, many of them too far from the first one: hubs gather them, so that few pairs
    are left to meet one by one, and the components are those of all pairs."""
    import random
    draw = random.Random(3)
    base = [f"w{i}" for i in range(140)]
    texts = []
    for i in range(240):
        words = list(base)
        for _ in range(draw.randrange(1, 9)):
            words[draw.randrange(140)] = f"x{i}y{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k:k + 5]) for k in range(136)} for t in texts]
    least = list(range(240))
    for i in range(240):  # components by all pairs
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    real, met = parity_join.written, {}

    def counted(df, name):
        out = real(df, name)
        if name == "rest-pairs":
            met[parity_join.HUB_ROUNDS] = out.count()
        return out
    monkeypatch.setattr(parity_join, "written", counted)
    rounds = parity_join.HUB_ROUNDS
    for n in (rounds, 0):
        monkeypatch.setattr(parity_join, "HUB_ROUNDS", n)
        got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(table).collect()}
        assert got == dict(enumerate(least))
    print(met)
    assert met.get(rounds, 0) * 4 <= met[0]


def test_stars_take_no_round_and_later_links_only_those_they_join(spark, monkeypatch):
    """Links that are stars already are read off; later links extend known components by
    the links between them alone, with the components of all links."""
    from quarry.llm import components as C
    rounds, followed = [], []
    star, whole = C._star, C.components
    monkeypatch.setattr(C, "_star", lambda links, both: rounds.append(both) or star(links, both))
    monkeypatch.setattr(C, "components", lambda links, a, b: followed.append(links.count()) or whole(links, a, b))
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    read = lambda found: {r.node: r.component for r in found.collect()}
    first = [(1, n) for n in range(2, 30)] + [(40, 41), (40, 42), (50, 51), (None, 3), (7, 7)]
    found = whole(links(first), "a", "b")
    assert read(found) == {**{n: 1 for n in range(1, 30)}, 40: 40, 41: 40, 42: 40, 50: 50, 51: 50}
    assert not rounds
    later = [(3, 9), (41, 51), (60, 61), (61, 62), (62, 42), (70, 71), (2, 28), (2, 28)]
    more = C.extended(found, links(later))
    assert read(more) == read(whole(links(first + later), "a", "b"))
    assert more.count() == 39 and followed == [5]
    assert read(C.extended(found, links([]))) == read(found)


def test_copies_are_dealt_once_and_few_tables_are_written(spark, monkeypatch):
    """F1 of r03: signatures are made of one document for all equal sets, and few tables lie between."""
    copied = text("copied", 60)
    made = {i: copied for i in range(1, 300)} | {i: text(f"own{i}", 40) for i in range(300, 320)}
    made |= {400: f"{copied} tail", 401: f"{made[300]} tail", 402: None, 403: "", 404: None}
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(6)
    real, tables = parity_join.written, []
    monkeypatch.setattr(parity_join, "written", lambda df, name: tables.append((name, real(df, name))) or tables[-1][1])
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(docs).collect()}
    assert got == {i: i for i in made} | {i: 1 for i in range(1, 300)} | {400: 1, 401: 300}
    groups = next(df for name, df in tables if name == "signature-groups")
    assert {r.doc_id for r in groups.select("doc_id").union(groups.select("hub")).distinct().collect()} == {1, 300, 400, 401}
    assert len(tables) <= 20


def test_groups_of_a_signature_go_on_in_the_next_batch(spark):
    rows = [(1, d, None) for d in (5, 3, 9, 4, 8, 7, 6)] + [(2, 20, None), (2, 21, None), (4, 40, None)]
    rows += [(3, 30, 30), (3, 31, 30), (3, 32, 32), (3, 33, 32), (5, 50, 50), (5, 51, 50)]
    table = spark.createDataFrame(rows, "signature long, doc_id long, hub long").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in (1, 2, 3, 10_000):
            spark.conf.set(name, size)
            found = parity_join.signature_groups(table).collect()
            for s, docs in {1: range(3, 10), 2: (20, 21), 3: range(30, 34), 5: (50, 51)}.items():
                met = [(r.hub, r.doc_id) for r in found if r.signature == s]
                assert len(met) == len(docs) - 1 and linked_pairs(met) == set(docs)
            assert all(r.many for r in found if r.signature != 2) and not [r for r in found if r.signature == 4]
    finally:
        spark.conf.set(name, before)


def linked_pairs(pairs):
    """The nodes reached from the first pair."""
    reached = set(pairs[0])
    for _ in pairs:
        reached |= {x for p in pairs if reached & set(p) for x in p}
    return reached
