"""Tokens, packing, sentences, overlaps and products."""

import random

import numpy as np
import pytest

from sparkloom.llm import sentences as S
from sparkloom.llm.overlaps import cross_split_pairs, overlap_classes, overlap_report
from sparkloom.llm.packing import pack, plan
from sparkloom.llm.products import product_groups, same_product
from sparkloom.llm.sentences import learnt_abbreviations, sentences, split_line, stopped_words
from sparkloom.llm.titles import agree, attributes, canonical_words
from sparkloom.llm.tokens import Lexicon, count_words, encode, frequent_words, load_ranks, merge_word, pieces, spaced

TEXTS = [
    None, "", " ", "\n", "a\n\n\n  b\n", "Hello  world \n x", "it's 12 I'll we've", "<|endoftext|> x", "x" * 3000, "　 全角 空格", "﻿BOM", "tab\t \tx\r\n", "คนไทย รัก", "ज़िले का", "é́ é", "🙂🙂 👩‍👩‍👧",
    "The gate opens at 6 a.m.\nThe gate opens at 6 a.m.\n",
]


def test_encoding_is_exact(spark):
    rng = random.Random(1)
    alphabet = "ab \n\t'ß漢字ก्1٣.,!-  "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string").repartition(3)
    enc = load_ranks()
    want = {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: list(r.ids) for r in encode(df, lexicon_words=200).collect()} == want
    assert {r.doc_id: r.n_tokens for r in encode(df, lengths_only=True).collect()} == {i: len(x) for i, x in want.items()}
    assert enc.decode(want[4]) == texts[4]


def test_word_counts_cover_all_texts(spark):
    import regex
    from collections import Counter

    from sparkloom.llm.tokens import PATTERN

    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(2)
    want = Counter(w for t in TEXTS if t for w in regex.findall(PATTERN, t))
    assert {r.word: r.n for r in count_words(df).collect()} == dict(want)


def test_frequent_words_are_bounded_and_counted_over_all_texts(spark):
    df = spark.createDataFrame([(f"aa bb aa cc {i}",) for i in range(8)] + [("dd dd",)], "text string").repartition(4)
    assert set(frequent_words(df, "text", 100)) == {"aa", " aa", " bb", " cc"}
    assert frequent_words(df, "text", 3) == []  # four words are equally frequent
    assert frequent_words(df, "text", 0) == []


def test_small_memories_change_nothing(spark, monkeypatch):
    from sparkloom.llm import tokens as TK

    monkeypatch.setattr(TK, "CACHE_CHARS", 10)
    monkeypatch.setattr(TK, "CACHE_WORDS", 3)
    monkeypatch.setattr(TK, "BATCH_CHARS", 20)
    enc = load_ranks()
    e = TK.Encoder(Lexicon.build({w: merge_word(enc, w) for w in ("a", " word", "Hello")}), "byte_bpe_50k", TK.TOKENIZER_DIR)
    for _ in range(2):
        for t in TEXTS:
            assert np.frombuffer(e.texts([t or "", "a word"])[0], np.int32).tolist() == enc.encode_ordinary(t or "")


def test_a_lexicon_that_cannot_be_mapped_travels_itself(spark, monkeypatch):
    from sparkloom.llm import tokens as TK

    monkeypatch.setattr(TK, "shared_dir", lambda s: "hdfs://share")
    opened = TK.fit_lexicon(spark.createDataFrame([("tap tap tap",)], "text string"), "text", "byte_bpe_50k", TK.TOKENIZER_DIR, 50)
    assert opened().find_all([b" tap"]) == [np.array(merge_word(load_ranks(), " tap"), np.int32).tobytes()]


def test_empty_corpus(spark):
    assert encode(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_lexicon_is_minimal_and_complete():
    enc = load_ranks()
    words = ["tap", "taps", "top", "tops", "stop", "stops", " house", "ü", "\n"]
    lex = Lexicon.build({w: merge_word(enc, w) for w in words})
    assert [np.frombuffer(x, np.int32).tolist() for x in lex.find_all([w.encode() for w in words])] == [merge_word(enc, w) for w in words]
    assert lex.find_all([b"ta", b"tapes", b"", b"\xff", b"taps"])[:4] == [None] * 4
    assert Lexicon.build({}).find_all([b"a", b""]) == [None, None]
    assert len(lex.arrays["final"]) < sum(len(w.encode()) for w in words)


def test_pieces_lose_nothing():
    for t in TEXTS:
        if t:
            assert "".join(pieces(t)) == t
            assert all(" ".join(spaced(p)) == p for p in pieces(t))


@pytest.mark.parametrize("capacity", [1, 7, 100, 512])
def test_plan_places_all_within_capacity(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 3, 2000):
        sizes = [rng.randint(1, capacity) for _ in range(n)]
        u, c = (x.tolist() for x in np.unique(np.array(sizes, int), return_counts=True))
        runs, k = plan(u, c, capacity)
        load = np.zeros(k, int)
        for r in runs:
            np.add.at(load, r.start + np.arange(r.n) // r.per, r.size)
        assert (load <= capacity).all() and load.sum() == sum(sizes) and (load > 0).all()
        for s, m in zip(u, c):
            at = 0
            for lo, count in sorted((r.lo, r.n) for r in runs if r.size == s):
                assert lo == at
                at += count
            assert at == m
        if n == 2000 and capacity >= 100:
            assert sum(sizes) / (k * capacity) > 0.95


def test_packing_keeps_every_token(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, 30, 99, 100, 101, 250, 1000])) for i in range(400)] + [(900, None), (901, 7), (901, 7)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, n_tokens bigint, pack_name string, part int")
    limits = spark.createDataFrame([("small", 100), ("large", 1000)], "pack_name string, capacity int")
    got = pack(docs, limits, ranked=20).collect()
    for name, capacity in (("small", 100), ("large", 1000)):
        own = [r for r in got if r.pack_name == name]
        load: dict = {}
        by_doc: dict = {}
        for r in own:
            if r.container_id is not None:
                load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
            by_doc.setdefault(r.doc_id, []).append(r)
        assert max(load.values()) <= capacity and set(load) == set(range(len(load)))
        for i, n in rows[:400]:
            parts = sorted(by_doc[i], key=lambda r: r.part)
            assert sum(p.n_tokens for p in parts) == n and [p.first_token for p in parts] == [k * capacity for k in range(len(parts))]
            assert len(parts) == 1 if n <= capacity else len(parts) == -(-n // capacity)
            assert (parts[0].container_id is None) == (n == 0)
        assert len(by_doc[901]) == 2 and by_doc[900][0].container_id is None
    assert pack(docs.limit(0), limits).collect() == []


CASES = [
    ("Mr. Fox and Mrs. Owl met. They left at 6 a.m. and slept.", ["Mr. Fox and Mrs. Owl met.", "They left at 6 a.m. and slept."]),
    ("It closed at 9 p.m. The end.<ref>A. Vol. 2.</ref> Next one", ["It closed at 9 p.m.", "The end.<ref>A. Vol. 2.</ref>", "Next one"]),
    ("* “It holds. The roof does not,” wrote K. L. Moe in 1911. Who knew?", ["“It holds. The roof does not,” wrote K. L. Moe in 1911.", "Who knew?"]),
    ("The sign reads: “Stop here. Go on!” He went.", ["The sign reads: “Stop here. Go on!”", "He went."]),
    ("Am 1. Mai 1900 kam er. Seit dem 18. Jh. steht es, z. B. hier usw. Dann nichts.", ["Am 1. Mai 1900 kam er.", "Seit dem 18. Jh. steht es, z. B. hier usw.", "Dann nichts."]),
    ("В 1797 г. Он жил на ул. Мира. Сеяли рожь и т. д. Конец.", ["В 1797 г.", "Он жил на ул. Мира.", "Сеяли рожь и т. д.", "Конец."]),
    ("“桥还在。屋顶没了。”他在1647年写道。塔高15.6米。", ["“桥还在。屋顶没了。”他在1647年写道。", "塔高15.6米。"]),
    ("「橋は残った。屋根は落ちた。」と彼は書いた。次の文", ["「橋は残った。屋根は落ちた。」と彼は書いた。", "次の文"]),
    ("มีบ้าน 42 หลัง หอคอยสูง 14.4 เมตร", ["มีบ้าน 42 หลัง", "หอคอยสูง 14.4 เมตร"]),
    ("मीनार 29.6 मीटर है। डॉ. राम ने लिखा।", ["मीनार 29.6 मीटर है।", "डॉ. राम ने लिखा।"]),
    ("ذكر د. علي ذلك في ج. 5 من الكتاب. من دفع؟", ["ذكر د. علي ذلك في ج. 5 من الكتاب.", "من دفع؟"]),
    ("Nobody agreed ... yet it stayed (who owned it? who sold it?) there. Ok", ["Nobody agreed ... yet it stayed (who owned it? who sold it?) there.", "Ok"]),
    ("Unclosed (bracket here. Next sentence.", ["Unclosed (bracket here.", "Next sentence."]),
    ("It was an account of it.Nobody agreed at maps.example.org/a.html today.", ["It was an account of it.", "Nobody agreed at maps.example.org/a.html today."]),
    ("Version 2.0.5 by St.Moe cost 3.5 marks at U.S.Steel", ["Version 2.0.5 by St.Moe cost 3.5 marks at U.S.Steel"]),
    ("== Title. More ==", []), ("[[Category:A. B]]", []), ("   ", []), ("|x. y", []), ("﻿: word", ["word"]), ("no end mark", ["no end mark"]),
]


LATTICE_CASES = [
    ("“快走！”他说，然后离开了。塔高15米。", ["“快走！”他说，然后离开了。", "塔高15米。"]),
    ("“桥还在。”他走过街道。", ["“桥还在。”", "他走过街道。"]),
    ("“桥还在。”这是一本小说。", ["“桥还在。”", "这是一本小说。"]),
    ("“快走！”的喊声传来。他跑了。", ["“快走！”的喊声传来。", "他跑了。"]),
    ("“桥还在。”母亲告诉我。他哭了。", ["“桥还在。”母亲告诉我。", "他哭了。"]),
    ("「橋は残った。」彼は言った。次の文。", ["「橋は残った。」彼は言った。", "次の文。"]),
    ("「橋は残った。」はじめに町が焼けた。", ["「橋は残った。」", "はじめに町が焼けた。"]),
    ("「橋は残った。」ところが屋根は落ちた。", ["「橋は残った。」", "ところが屋根は落ちた。"]),
    ("「橋は残った。」町は焼けた。", ["「橋は残った。」", "町は焼けた。"]),
    ("モーニング娘。のメンバーは歌った。次の文。", ["モーニング娘。のメンバーは歌った。", "次の文。"]),
    ("橋は残った。が、屋根は落ちた。", ["橋は残った。", "が、屋根は落ちた。"]),
    ("橋は残った。のちに町が焼けた。", ["橋は残った。", "のちに町が焼けた。"]),
]


@pytest.mark.parametrize(("line", "want"), LATTICE_CASES)
def test_gaps_of_scripts_without_spaces(line, want):
    assert [line[a:b] for a, b in split_line(line)] == want


@pytest.mark.parametrize(("line", "want"), CASES)
def test_sentence_cases(line, want):
    assert [line[a:b] for a, b in split_line(line)] == want


def test_abbreviations_are_learnt_from_the_texts(spark):
    text = "The Fed. Reserve met. It was late."
    alone = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = lambda df: [text[r.start_char : r.end_char] for r in sorted(sentences(df).filter("doc_id = 1").collect(), key=lambda r: r.start_char)]
    assert found(alone) == ["The Fed.", "Reserve met.", "It was late."]
    more = spark.createDataFrame([(k, f"Then the Fed. {w} again. All was well.") for k, w in enumerate("said met rose fell lent paid cut held kept sold".split(), 2)], "doc_id bigint, text string")
    assert found(alone.unionByName(more)) == ["The Fed. Reserve met.", "It was late."]
    counts = {r.word: (r.n_small, r.n_other) for r in stopped_words(alone.unionByName(more)).collect()}
    assert counts["fed"] == (10, 1) and counts["again"] == (0, 10) and counts["met"] == (0, 1)


def test_no_learnt_abbreviation_is_dropped(spark, monkeypatch):
    """More words than the driver takes, the rarer ones too, and one behind all others."""
    words = [*(a + b + "x" for a in "bcdfg" for b in "aeiou"), "зб", "𐐨𐐨"]
    counts = {w: 10 + 40 * (k % 2) for k, w in enumerate(words)}
    rows = [f"Then the {w}. said again. All was well." for w, n in counts.items() for _ in range(n)]
    probe = "\n".join(f"The {w}. Reserve met." for w in words)
    df = spark.createDataFrame([(0, probe), *enumerate(rows, 1)], "doc_id bigint, text string")
    monkeypatch.setattr(S, "MOST_LEARNT", 10)
    assert isinstance(learnt_abbreviations(df), S.StoredWords)
    got = sorted((r.start_char, r.end_char) for r in sentences(df).filter("doc_id = 0").collect())
    assert [probe[a:b] for a, b in got] == probe.split("\n")
    stored = learnt_abbreviations(df)
    assert all(w in stored for w in words) and not any(w in stored for w in ("", "a", "again", "baxx", "𐐩", "vol"))


def test_sentence_positions_are_code_points(spark):
    text = "🙂 One. Two.\r\n\n* Three\n" + "Abc def. " * 20_000
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, " \n ", 0)], "doc_id bigint, text string, start_char int")
    got = sorted((r.doc_id, r.start_char, r.end_char) for r in sentences(df).collect())
    assert [text[a:b] for _, a, b in got[:3]] == ["🙂 One.", "Two.", "Three"] and len(got) == 20_003 and {r[0] for r in got} == {1}
    assert sentences(df.limit(0)).collect() == []


CATALOG = "item_id bigint, title string, parent_asin string, split string, main_category string, hash string, train string"


def test_overlaps(spark):
    base = "Kadoco Storage Basket Sulaboda, green, 762 mm, 5,000 mAh"
    rows = [
        (1, base, "A1", "train"), (2, "KADOCO storage  básket Sulaboda | green | 762 mm | 5000 mAh", "A2", "val"), (3, base + " - Top Quality", "A3", "test"),
        (4, "Kadoco Kadoco Storage Basket Sulaboda, green, 762 mm, 5,000 mAh", "A4", "test"), (5, base.replace("Basket", "Baskte"), "A5", "val"), (6, base.replace("762", "763"), "A6", "val"),
        (7, base.replace("green", "red"), "A7", "val"), (8, "", "A8", "val"), (9, None, "A9", "train"), (10, "", "a1 ", "test"), (11, "Top Quality", "A11", "train"), (12, "Best Seller", "A12", "test"),
        (13, base, "A13", "train"), (14, base, "A14", None), (15, "<b>Kadoco</b>&nbsp;Storage Basket Sulaboda, green, 762 mm, 5,000 mAh", None, "val"), (16, None, None, "train"),
    ]
    df = spark.createDataFrame([(*r, "C", "h", "t") for r in rows], CATALOG)
    got = {(r.eval_id, r.train_id) for r in cross_split_pairs(df).collect()}
    assert got == {(e, t) for e in (2, 3, 4, 5, 15) for t in (1, 13)} | {(10, 1)}
    report = {r.split: (r.n_rows, r.n_pairs) for r in overlap_report(df, cross_split_pairs(df)).collect()}
    assert report == {"val": (3, 6), "test": (3, 5)}
    assert cross_split_pairs(df.limit(0)).collect() == []


def test_overlaps_of_stutters_capital_entities_and_two_swaps(spark):
    base = "Space Saving Kadoco Storage Basket Sulaboda 12.7 cm"
    rows = [
        (1, base, "train"), (2, "Space Space Saving Kadoco Storage Basket Sulaboda 12.7 cm", "val"), (3, "SPACE SAVING KADOCO&NBSP;STORAGE BASKET SULABODA 12.7 CM", "test"),
        (4, "Kadoco Storage Basket Sulaboda 12.7 Kadoco Storage Basket Sulaboda 12.7 cm", "val"), (5, "Kadoco Stoarge Baskte Sulaboda 12.7 cm", "val"), (6, "Kadoco Stoarge Baskte Sulabdoa 12.7 cm", "val"),
        (7, "Kadoco Stxrage Bxsket Sulaboda 12.7 cm", "val"),
    ]
    df = spark.createDataFrame([(i, t, f"K{i}", s, "C", "h", "t") for i, t, s in rows], CATALOG)
    assert {(r.eval_id, r.train_id) for r in cross_split_pairs(df).collect()} == {(2, 1), (3, 1), (4, 1), (5, 1)}


def test_overlaps_of_a_template(spark, monkeypatch):
    from sparkloom.llm import overlaps as OV

    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(120)]
    rows = [(k, f"Replacement battery for {n} laptops", "train") for k, n in enumerate(names)]
    rows += [(1000 + k, f"Replacement battery for {n[:3] + n[4] + n[3] + n[5:] if k % 2 else n[1:]} laptops", "val") for k, n in enumerate(names)]
    df = spark.createDataFrame([(i, t, f"K{i}", s, "C", "h", "t") for i, t, s in rows], CATALOG)
    plain = {tuple(r) for r in cross_split_pairs(df).collect()}
    monkeypatch.setattr(OV, "MOST_PAIRS", 10)
    assert {tuple(r) for r in cross_split_pairs(df).collect()} == plain and len(plain) >= 120


def test_overlap_classes_count_copies_without_pairs(spark):
    df = spark.createDataFrame([(i, "Red  Mug" if i % 2 else "red mug!", f"K{i}", "train" if i < 30 else "val", "C", "h", "t") for i in range(50)] + [(99, None, "K", "val", "C", "h", "t")], CATALOG)
    got = overlap_classes(df).collect()
    assert len(got) == 50 and {r.n_train for r in got} == {30} and len({r["class"] for r in got}) == 1


def test_overlaps_of_short_titles(spark):
    rows = [
        (1, "Storage Basket", "train"), (2, "Storage Baskte - Top Quality", "val"), (3, "Storge Basket", "test"), (4, "Storrage Basket", "val"), (5, "Storge Baskte", "val"), (6, "Basket Storage", "val"),
        (7, "Sulaboda", "train"), (8, "Sulabodda", "val"), (9, "sulabdoa", "test"), (10, "Sulabada", "val"), (11, "Sulubada", "val"), (12, "Red Mug", "train"), (13, "Red Rug", "val"), (14, "Reds Mug", "val"),
        (15, "Mug 12", "train"), (16, "Mug 13", "val"), (17, "Kadoco", "val"),
    ]
    df = spark.createDataFrame([(i, t, f"K{i}", s, "C", "h", "t") for i, t, s in rows], CATALOG)
    assert {(r.eval_id, r.train_id) for r in cross_split_pairs(df).collect()} == {(2, 1), (3, 1), (4, 1), (8, 7), (9, 7), (10, 7)}


ITEMS = "parent_asin string, title string, store string, features string, categories array<string>, class string, brand string"


def test_products(spark):
    rows = [
        ("P1", "Tumuba Bilakaso Frying Pan red 20.3 cm 1 pc", "s", "Brand: Tumuba", ["a", "b", "Frying Pan"]),
        ("P2", "Tumuba Skillet Bilak-aso Red Single 8 in", "t", "Brand: Tumuba", ["a", "b", "Frying Pan"]),
        ("p2 ", "Skillet Bilakaso by Tumuba, Premium, 203 mm", "t", "", ["a"]),
        ("P3", "Tumuba Bilakaso Frying Pan red 20.3 cm Pack of 10", "s", "Brand: Tumuba", ["a", "b", "Frying Pan"]),
        ("P4", "Tumuba Bilakaso Frying Pan blue 20.3 cm 1 pc", "s", "Brand: Tumuba", ["a", "b", "Frying Pan"]),
        ("P5", "Tumuba Ravikelo Frying Pan red 20.3 cm 1 pc", "s", "Brand: Tumuba", ["a", "b", "Frying Pan"]),
        ("P6", "Sisaworks Ravimodo Frying Pan red 20.3 cm 1 pc", "s", "Brand: Sisaworks", ["a", "b", "Frying Pan"]),
        ("P7", None, None, None, None), ("", "Tumuba Bilakaso Frying Pan red 20.3 cm 1 pc", "s", "", None), (None, "x", None, None, None),
    ]
    rows += rows[:2]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], ITEMS)
    got = {tuple(r) for r in same_product(df).collect()}
    assert got == {("P1", "P2"), ("P1", "p2 "), ("P2", "p2 "), ("P3", "p2 "), ("P4", "p2 ")}
    groups = {r.parent_asin: r["product"] for r in product_groups(df).collect()}
    assert groups["P1"] == groups["P2"] == groups["p2 "] and groups["P5"] != groups["P1"] != groups["P6"]
    assert same_product(df.limit(0)).collect() == []


def test_a_line_of_very_many_classes(spark, monkeypatch):
    """Every listing is a class of its own and shares the line's name; two of each size describe one product."""
    from sparkloom.llm import products as PD

    monkeypatch.setattr(PD, "BLOCK", 256)
    rows = [(f"Q{i:05d}", f"Tumuba Bilakaso {'Frying Pan' if i % 2 else 'Skillet'} AB-{10000 + i // 2}", "s", "Brand: Tumuba", ["a", "b", "Frying Pan"]) for i in range(3000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], ITEMS)
    assert {tuple(r) for r in same_product(df).collect()} == {(f"Q{i:05d}", f"Q{i + 1:05d}") for i in range(0, 3000, 2)}


def test_frequent_words_without_a_brand_block_with_a_second_word(spark, monkeypatch):
    from sparkloom.llm import products as PD

    monkeypatch.setattr(PD, "RARE", 2)
    rows = [("A1", "Bilakaso Ravikelo pan 8 in", None, "", ["a"]), ("A2", "Ravikelo Bilakaso skillet 8 in", None, "", ["a"]), ("A3", "Bilakaso Sumodo pan 9 in", None, "", ["a"]), ("A4", "Bilakaso Dorime lid", None, "", ["a"])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], ITEMS)
    made, _ = PD.classes(df)
    n = PD.blocked(made).groupBy("block").count().filter("count > 1").count()
    assert n >= 1 and ("A1", "A2") in {tuple(r) for r in same_product(df).collect()}


def test_pairs_within_large_groups_are_divided(spark, monkeypatch):
    from sparkloom.llm import products as PD

    monkeypatch.setattr(PD, "PAIRED", 7)
    g = spark.createDataFrame([("g", f"k{i:02d}") for i in range(40)] + [("h", "k00"), ("h", "k01"), ("i", "k05"), ("h", "k01")], "g string, p string")
    got = [tuple(r) for r in PD.pairs_within(g, "g", "p").collect()]
    assert len(got) == 40 * 39 // 2 + 1 and all(a < b for a, b in got)


def test_attributes():
    a = attributes("Pan 8 in 3pk LW-76390-B blk", "Quantity: Set of Three | Size: 203 mm")
    assert a["count"] == {3} and a["model"] == {"LW76390B"} and a["colour"] == {"black"} and len(a["length"]) == 2
    b = attributes("Mat - 5 in - FT-61886 - Pack of 8 CM 41640D 4 ft 12000 mAh", "Model: KG-39118 | Contents: 8-Pack")
    assert b["count"] == {8} and b["model"] == {"FT61886", "CM41640D", "KG39118"} and b["charge"] == {12000.0} and b["length"] == {127.0, 1219.2}
    assert agree({"length": {203.2}}, {"length": {203.0}}) and not agree({"memory": {1024.0}}, {"memory": {256.0}}) and agree({"count": {1}}, {})
    assert canonical_words("Kadoco <b>Basket</b> basket, Best Choice!") == ("kadoco", "basket")
