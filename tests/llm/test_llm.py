"""The llm operators against brute force, exact round trips, and awkward rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ampmill.llm import bpe, canonical, entities, lookalike, packing, personal

# --- 6 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_encoder_equals_reference(reference):
    e, rnd = bpe.Encoder(bpe.default_vocabulary()), random.Random(3)
    texts = ["", " ", "<|endoftext|>", "a" * 3000, " " * 999 + "x", "it's 12 o'clock\n\n\tΩ 漢字 🎉é"]
    texts += ["".join(rnd.choice("aabcde 'st01é漢🎉Ω\n\t​") for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    assert [e.encode(t) for t in texts] == [reference(t) for t in texts]


def test_encode_corpus_rows(spark, reference):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "volts", 5), (3, "volts", 5), (4, "x " * 50_000, None)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(docs).collect())
    assert got == sorted([(1, []), (2, []), (3, reference("volts")), (3, reference("volts")), (4, reference("x " * 50_000))])
    assert bpe.encode_corpus(docs.limit(0)).count() == 0


# --- 7 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_packing_holds_every_item(seed):
    rnd = random.Random(seed)
    h = Counter(rnd.choice([rnd.randint(1, 100), rnd.randint(1, 30), rnd.randint(40, 100)]) for _ in range(rnd.randint(1, 400)))
    runs = packing.pack_histogram(h, 100, groups=6, small_parts=5)
    held = Counter()
    for content, n in runs:
        assert sum(content) <= 100 and n > 0
        for s in content:
            held[s] += n
    assert held == h
    # first-fit decreasing in plain form
    bins = []
    for s in sorted(h.elements(), reverse=True):
        k = next((i for i, b in enumerate(bins) if b + s <= 100), None)
        if k is None:
            bins.append(s)
        else:
            bins[k] += s
    assert sum(n for _, n in runs) <= 1.15 * len(bins) + 2


def test_packing_work_does_not_grow_with_counts():
    h = {s: 1_000_000 * (1 + s % 7) for s in range(1, 2049, 3)}
    runs = packing.pack_histogram(h)
    assert len(runs) < 10_000 and sum(n * sum(c) for c, n in runs) == sum(s * n for s, n in h.items())


@pytest.mark.parametrize("middle, waste", [(4.5, 0.002), (5.5, 0.005), (6.8, 0.025)])
def test_unused_space_at_scale(middle, waste):
    """Half a billion documents, few or many of them small: containers above the lower bound."""
    import math

    h = {s: int(1e6 * math.exp(-(((math.log(s) - middle) / 1.1) ** 2) / 2)) for s in range(1, 2049)}
    assert sum(n for _, n in packing.pack_histogram(h)) <= (1 + waste) * sum(s * n for s, n in h.items()) / 2048


def test_pack_documents(spark):
    rows = [(i, 700) for i in range(6)] + [(10, 0), (11, None), (12, 5000), (13, 2048), (14, 2049), (14, 2049)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, n_tokens int")).collect()
    assert Counter(r.doc_id for r in got) == Counter({**{i: 1 for i in range(6)}, 10: 1, 11: 1, 12: 3, 13: 1, 14: 4})
    room = Counter()
    for r in got:
        room[r.container_id] += r.piece_tokens
    assert max(room.values()) <= 2048 and all(r.container_id is not None for r in got)
    assert {r.doc_id for r in got if r.n_pieces > 1} == {12, 14}
    apart = {d: {r.container_id for r in got if r.doc_id == d} for d in (0, 10, 12, 13, 14)}
    assert {d for d, c in apart.items() if len(c) > 1} == {12, 14}
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, n_tokens int")).count() == 0


def test_rank_within_is_a_ranking(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id"))
    got = packing.rank_within(df, "k", "id", 8).collect()
    for k in range(3):
        mine = sorted(r["rank"] for r in got if r.k == k)
        assert mine == list(range(len(mine)))


# --- 5 ------------------------------------------------------------------------------------------

CELLS = [
    ("text", "plain text 5 Ω μA ² ½ ™ – x̄", None),
    ("text", "Температура корпуса 9 мОм", None),
    ("text", "σ of α", None),
    ("text", "Ganzе Zahl", "Ganze Zahl"),
    ("text", "ａｂｃ １２", "abc 12"),
    ("text", "Café", "Café"),
    ("text", "a b​c", "a bc"),
    ("text", "efﬁcient Ⅲ", "efficient III"),
    ("text", "25 ℃ and 20 ºC", "25 °C and 20 °C"),
    ("text", "lead‑free", "lead-free"),
    ("text", "", None),
    ("text", None, None),
    ("unit", "nС", "nC"),
    ("unit", "А", "A"),
    ("unit", "mΩ", "mΩ"),
    ("unit", "㎊", "pF"),
    ("unit", "Ω", None),
    ("unit", "µA", "μA"),
]


def test_lookalikes(spark):
    rows = [(f, i, v) for i, (f, v, _) in enumerate(CELLS)] * 2
    got = {}
    for r in lookalike.canonical_cells(spark.createDataFrame(rows, "field string, row_id long, value string")).collect():
        got.setdefault(r.row_id, set()).add((r.canonical, r.changed))
    want = {i: {(v if c is None or c == v and v.isascii() else c, c is not None)} for i, (_, v, c) in enumerate(CELLS)}
    # the ohm sign itself is a case, its plain form isn't
    want[14] = {("mΩ", CELLS[14][1] != "mΩ")}
    assert got == want


def test_invisible_spellings_fall_together(spark):
    rows = [("text", i, v) for i, v in enumerate(["Gate charge", "G​ate charge", "Gate charge", "Gаte chаrge"])]
    got = lookalike.canonical_cells(spark.createDataFrame(rows, "field string, row_id long, value string")).collect()
    assert {r.canonical for r in got} == {"Gate charge"}


def test_collation_decides_the_classes(spark):
    """Accents aren't mapped: cells fall together by the collation, with the plain member as canonical form."""
    cells = ["Vi\u1ebft", "Vie\u0302\u0301t", "Vi\u00ea\u0301t", "10 \u212b", "10 \u00c5", "o\u0301hm", "a\u037e", "x\u0304", "Vi\u1ec7t"]
    df = spark.createDataFrame([("text", i, v) for i, v in enumerate(cells)], "field string, row_id long, value string")
    got = {r.row_id: (r.canonical, r.changed) for r in lookalike.canonical_cells(df).collect()}
    assert [got[i][0] for i in range(9)] == ["Vi\u1ebft", "Vi\u1ebft", "Vi\u1ebft", "10 \u00c5", "10 \u00c5", "\u00f3hm", "a\u037e", "x\u0304", "Vi\u1ec7t"]
    assert [i for i in range(9) if got[i][1]] == [1, 2, 3, 5]
    plan = lookalike.canonical_cells(df).filter("changed")._jdf.queryExecution().optimizedPlan().toString()
    assert "collationkey" in plan.lower()


# --- 2 ------------------------------------------------------------------------------------------

CANON = [(1, "mfr", "Ostrenn Semiconductor", ["ostrenn"]), (2, "mfr", "Norvolta Semiconductor", ["norvolta"]), (3, "mfr", "Norvalda Devices", None), (4, "housing", "TO-263", ["D2PAK"]), (5, "housing", "TO-263-7", ["D2PAK-7"]), (6, "housing", "SOT-23", []), (7, "housing", "DFN 8x8", [])]
VALUES = [("mfr", "OSTRENN K.K.", 1), ("mfr", "Semiconductor Ostrenn", 1), ("mfr", "Norvalta Devices", 3), ("mfr", "Norvlota Semiconducor", 2), ("mfr", "Blushortisun", 0), ("housing", "d2pak7", 5), ("housing", "TO–263", 4), ("housing", "Case T0-263", 4), ("housing", "SOT-523", 0), ("housing", "dfn (8×8)", 7), ("housing", "potted", 0)]


def test_canonical_values(spark):
    canon = spark.createDataFrame(CANON, "canon_id long, kind string, name string, aliases array<string>")
    v = spark.createDataFrame([x[:2] for x in VALUES] * 2 + [("mfr", None)], "field string, value string")
    got = {(r.field, r.value): r.canon_id for r in canonical.match_values(v, canon).collect()}
    assert got == {x[:2]: x[2] for x in VALUES}
    assert {r.canon_id for r in canonical.match_values(v, canon.limit(0)).collect()} == {0}
    assert canonical.match_values(v.limit(0), canon).count() == 0


def test_prefix_filter_loses_no_pair(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 8))) for _ in range(80)]
    sets = {w: {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)} for w in set(words)}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    df = spark.createDataFrame([(w,) for w in sets], "w string").withColumn("tokens", canonical._tokens(F.col("w")))
    counts = df.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    for t in (0.25, 0.6):
        a = canonical._prefixes(canonical._by_rarity(df, counts, ["w"]), t, "a_")
        b = canonical._prefixes(canonical._by_rarity(df, counts, ["w"]), t, "b_")
        met = {tuple(r) for r in a.join(b, "token").select("a_w", "b_w").distinct().collect()}
        assert {(x, y) for x in sets for y in sets if jaccard(x, y) >= t} <= met


# --- 3 ------------------------------------------------------------------------------------------


def test_match_listings(spark):
    canon = spark.createDataFrame(CANON, "canon_id long, kind string, name string, aliases array<string>")
    p = "part_id long, mfr string, mpn string, housing string, Vds_max double, Rds_on_max double, Id double, Qg double"
    parts = spark.createDataFrame([(1, "ostrenn", "OSX2H8RQN10K", "TO-263", 100.0, 5e-3, 60.0, 3e-8), (2, "Ostrenn Semiconductor", "OSX2H8RQN10KQTR1", "D2PAK", 100.0, 5e-3, 60.0, 3e-8), (3, "norvolta", "OSX2H8RQN10K", "SOT-23", 100.0, 50e-3, 6.0, 1e-9), (4, "ostrenn", "OSX2H8RQN20K", "TO-263", 200.0, 25e-3, 30.0, 3e-8), (5, None, None, None, None, None, None, None)], p)
    s = "listing_id long, mfr string, mfr_part string, vdss string, rds_on string, gate_charge string, id_25c string, vgs_th string, package_case string"
    listings = spark.createDataFrame([(101, "Ostrenn", "OSX-2H8RQN10K/TAPE7", "100 V", "5 mΩ @ 20A, 10V", "30 nC @ 10 V", "60A (Tc)", None, "TO-263"), (102, None, "OSX2H8RQN10K", "0.1 kV", "50mOhm @ 5A", "1 nC @ 10 V", "6 A", None, "SOT23"), (103, "Ostrenn", "osx2h8rqnIok (new)", "100V", "5.05mR @ 5A", None, None, None, None), (104, "Ostrenn", "OSX2HR8QN20K", "200 V", "25 mΩ", None, "30 A", None, None), (105, "Ostrenn", "OSXAAAAAN10K", "100 V", None, None, None, None, None), (106, None, None, None, None, None, None, None, None), (101, "Ostrenn", "OSX-2H8RQN10K/TAPE7", "100 V", "5 mΩ @ 20A, 10V", "30 nC @ 10 V", "60A (Tc)", None, "TO-263")], s)
    got = Counter((r.part_id, r.listing_id) for r in entities.match_listings(parts, listings, canon).collect())
    assert got == Counter({(1, 101): 2, (2, 101): 2, (3, 102): 1, (1, 103): 1, (2, 103): 1, (4, 104): 1})
    assert entities.match_listings(parts.limit(0), listings, canon).count() == 0


def test_messages_agree_with_exact_marginals_on_a_tree(spark):
    import math
    from itertools import product

    prior = {("a", 1): 1.0, ("a", 2): 0.5, ("b", 2): 0.8}
    df = spark.createDataFrame([(hash(k[0]) % 97, k[1], v) for k, v in prior.items()], "l long, p long, prior double")
    weight = {}
    for on in product((0, 1), repeat=3):
        (x, y, z) = on
        w = math.exp(sum(o * v for o, v in zip(on, prior.values()))) * (0 if x and y else 1) * (math.exp(-entities.FURTHER_OFFER) if y and z else 1)
        weight[on] = w
    exact = [sum(w for on, w in weight.items() if on[i]) / sum(weight.values()) for i in range(3)]
    got = {(r.l, r.p): r.probability for r in entities.match_probabilities(df).collect()}
    assert [got[hash(k[0]) % 97, k[1]] for k in prior] == pytest.approx(exact, abs=0.02)


# --- 8 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(2)
    given = ["Anton", "Beate", "Carla", "Dario", "Elin", "Felix", "Greta", "Hugo"]
    sur = ["".join(rnd.choice(["wex", "tor", "mar", "len", "dun"]) for _ in range(2)).title() + "al" for _ in range(60)]
    docs = []
    for _ in range(400):
        g, s = rnd.choice(given + ["Ysolde", "Aurek"]), rnd.choice(sur)
        docs.append(f"My colleague {g} {s} ran the test. Call +49 30 23125 {rnd.randint(100, 999)} and ask for {g} {s}. The Zener Clamp at {rnd.randint(2, 9)} V saved the gate. My passport no. XK{rnd.randint(1000000, 9999999)} is new. Order 4500-{rnd.randint(10000, 99999)} is late. Miller Plateau sits low.")
    return personal.train(docs, given, personal.words_of(["Ostrenn Semiconductor"]))


def found(model, text):
    return {(k, text[a:b]) for k, a, b in personal.mentions([text], model)[0]}


def test_personal_information(model):
    text = "My colleague Anton Wextoral ran the test. Call +49 30 23125 444 and ask for Beate. Write to a.wextoral@mail.example, 12 Old Mill Lane, or Mühlgasse 7b. My passport no. XK1234567 is new. Order 4500-12345 is late. The Zener Clamp by Ostrenn."
    assert found(model, text) == {("person", "Anton Wextoral"), ("person", "Beate"), ("phone", "+49 30 23125 444"), ("email", "a.wextoral@mail.example"), ("address", "12 Old Mill Lane"), ("address", "Mühlgasse 7b"), ("id_number", "XK1234567")}


@pytest.mark.parametrize("text", ["QQ 52 67 23 B", "QQ895126D", "XK526723"])
def test_lettered_id_numbers_of_six_digits(model, text):
    assert [(n.kind, n.text) for n in personal.nodes_of(f"it took 3.51 W, 48 of 297: {text}.") if n.kind == "number"] == [("number", text)]
    assert found(model, f"My passport no. {text} is new.") == {("id_number", text)}


def test_units_are_no_initials(model):
    words = lambda t: [n.text for n in personal.nodes_of(t) if n.kind == "word"]
    assert words("at 36 V. Frau Beate and 25 °C. Anton, by V. Frau") == ["V", "Frau", "Beate", "C", "Anton", "V.", "Frau"]
    assert ("person", "Beate") in found(model, "It was 36 V. My colleague Frau Beate ran the test.")


@pytest.mark.parametrize("text", ["d.ost (at) lab.example", "d.ost at lab dot example", "D.Ost@LAB.EXAMPLE", "d.ost+x@eu.lab.example"])
def test_email_spellings(model, text):
    assert found(model, f"mail {text}, please") == {("email", text)}


def test_skip_edges_spread_a_label():
    unary = __import__("numpy").array([[0.0, 4.0, -60], [0.0, -0.5, -60]])
    edge = __import__("numpy").array([[0, 1]])
    table = __import__("numpy").array([[[0.0, -2.0, 0], [-2.0, 2.5, 0], [0, 0, 0]]])
    assert list(personal.infer(unary, edge[:0], table[:0]).argmax(1)) == [1, 0]
    assert list(personal.infer(unary, edge, table).argmax(1)) == [1, 1]


def test_messages_settle_or_say_so(monkeypatch):
    import warnings

    import numpy as np

    rnd = np.random.default_rng(1)
    unary, edges = rnd.normal(size=(40, 3)), rnd.integers(0, 40, size=(60, 2))
    edges = edges[edges[:, 0] != edges[:, 1]]
    table = np.broadcast_to(np.array([[1.0, -1.0, 0], [-1.0, 1.5, 0], [0, 0, 0]]), (len(edges), 3, 3))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        settled = personal.infer(unary, edges, table)
    monkeypatch.setattr(personal, "TOLERANCE", 1e-6)
    assert np.abs(settled - personal.infer(unary, edges, table)).max() < 0.1
    monkeypatch.setattr(personal, "ROUNDS", 2)
    with pytest.warns(UserWarning, match="settled"):
        personal.infer(unary, edges, table)


def test_left_out_alternatives_never_match():
    whole = personal._CHUNKS[True]
    texts = ["Mail a.b at lab dot example to 12 Old Mill Lane", "x@y.example", "Mühlgasse 7b und Calle Mayor 3", "12 bis rue de la Paix", "Am Hang 4, Tel +49 30 23125 444", "C/ Real, 5", "nothing (at) all", "St. John"]
    spans = lambda p, t: [(m.lastgroup, m.span()) for m in p.finditer(t)]
    assert all(spans(personal._chunks(t), t) == spans(whole, t) for t in texts)


def test_redact(spark, model):
    docs = spark.createDataFrame([(1, "Ask a.b@c.example now 🎉 d@e.example", None), (2, None, None), (3, "", "x"), (4, "nothing here", None)], "doc_id long, text string, mfr string")
    f = personal.find_personal(docs, model)
    assert {r.doc_id: r.text for r in personal.redact(f).collect()} == {1: "Ask [EMAIL] now 🎉 [EMAIL]", 2: None, 3: "", 4: "nothing here"}
