"""The ten operators against brute force, on awkward tables: nulls, empty and long texts, ties, repeats, clashes."""

import bisect
import fnmatch
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagoon.llm import html_text, licenses, packing, simhash, token_counts, topk, toxicity
from lagoon.llm.chat import chat_windows, digests, read_back
from lagoon.llm.decontaminate import Passages, benchmark_overlaps, drop_contaminated, normalise
from lagoon.llm.packing import minimum_bin_slack, pack, sequences
from lagoon.llm.url_filter import EXPLICIT, Rule, default_patterns, judge_urls

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"Word{i % 977}, and" for i in range(9000))
TEXTS = [
    (1, "Hello world, it's 1st  of MAY.\n\n tabs\tand more"),
    (2, ""),
    (3, None),
    (4, "naïve ÉCOLE über 東京 😀 <|endoftext|> x y <|ENDOFTEXT|>"),
    (5, LONG),
    (5, LONG),
    (6, "one"),
    (7, "two words"),
    (None, "a text without an id, but words"),
    (8, "   \n\t "),
    (9, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40),
]
CLASH = "doc_id bigint, text string, id string, fp string, n_tokens string, score string, words string, found string, length string, part string, sequence_id string, n bigint"


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", "x", "x", "x", 1) for r in rows], CLASH)


def test_token_counts(spark):
    t = Tokenizer.from_file(BYTE)
    got = token_counts.token_counts(docs(spark), BYTE).collect()
    want = sorted((str(i), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in TEXTS)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert token_counts.token_counts(docs(spark, []), BYTE).count() == 0


def test_token_counts_like_the_library():
    t, c, rng = Tokenizer.from_file(BYTE), token_counts.BpeCounter(BYTE, cache=200), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "aaaa", "The", "'s", "'LL", "1", "½", "é", "東京", "😀", " ", " ", "<|endoftext|>", "...", "\x00", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert c.count(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert c.count(["ab " * 400], block=50) == [len(t.encode("ab " * 400).ids)]


PAGE = """<html><head><title>no</title><script>var t="</p>";</script></head><body><div id="cookie-notice">We use cookies</div>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy now, the best offer of all times!</div>
<article><h1>A   title &amp; more</h1><p>First <b>bold<br>text</b> of the article, which is long enough to count.
<p>Second&nbsp;one &lt;here&gt;.</p><aside class="related">Related stories you may like to read</aside><p>Short.</p></article>
<section class="comments"><p>I am a reader and this is my long comment on it, with many words.</p></section>
<form><p>Sign up here for our letter, please</p><input></form><footer>&copy; us</footer>"""


def test_html(spark):
    want = "A title & more\n\nFirst bold text of the article, which is long enough to count.\n\nSecond one <here>.\n\nShort."
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (4, "u", "<p>" * 5000, "x"), (5, "u", "<p>unclosed <b>text which goes on for a good number of words here.", "x"), (5, "u", "<", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_main_text(df).collect()}
    assert (1, want, len(want)) in got and (2, "", 0) in got and (None, "", 0) in got
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_minimum_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(labels, odds=odds, edges=edges):
            return sum(max(o, 0) if not s else max(-o, 0) for o, s in zip(odds, labels, strict=True)) + sum(c for i, j, c in edges if labels[i] != labels[j])

        best = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(2**n))
        assert cost(html_text.minimum_cut(odds, edges)) == pytest.approx(best, abs=1e-6)


def fewest_edits(a, b):
    prev = [0] * (len(b) + 1)
    for i in range(1, len(a) + 1):
        cur = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            cur[j] = min(prev[j - 1] + (a[i - 1] != b[j - 1]), prev[j] + 1, cur[j - 1] + 1)
        prev = cur
    return min(prev)


def test_decontamination_against_alignment():
    rng = random.Random(7)
    piece = ["the", "ing", "tion", "of", "er", "an", "st", "re"]
    say = lambda n: " ".join(rng.choice(piece) + rng.choice(piece) for _ in range(n))
    items = [say(rng.randint(6, 24)) for _ in range(12)]
    (p,) = Passages.tiers(list(range(12)), items, 8, 0.1)
    for _ in range(80):
        i = rng.randrange(12)
        s = list(items[i])
        for _ in range(rng.randint(0, 2 * int(p.edits[i]))):
            q = rng.randrange(len(s))
            s[q : q + rng.randint(0, 1)] = rng.choice(["x", "", "e"])
        text = f"{say(rng.randint(0, 30))}\n {''.join(s).upper()}  {say(rng.randint(0, 30))}"
        got = {}
        for _, item, begin, end, edits in p.matches([say(4), text]):
            got[item] = min(edits, got.get(item, 99))
            assert 0 <= begin < end <= len(text)
        plain = "".join(map(chr, normalise(text)[0]))
        for j in range(12):
            d = fewest_edits("".join(map(chr, p.codes[j])), plain)
            assert got.get(j) == (d if d <= p.edits[j] else None)


def test_decontamination_of_short_passages():
    rng = random.Random(8)
    items = ["".join(rng.choice("abc ") for _ in range(n)).strip() or "x" for n in (*range(1, 46),)]
    tiers = Passages.tiers(list(range(len(items))), items, 8, 0.1)
    whole = {p.ids[i]: (p, i) for p in tiers for i in range(len(p.ids))}
    assert sorted(whole) == list(range(len(items)))
    for i, (p, k) in whole.items():
        assert p.edits[k] == len(p.codes[k]) // 10 and p.need[k] > 0
    for _ in range(60):
        i = rng.randrange(len(items))
        s = list(items[i])
        for _ in range(rng.randint(0, 2)):
            s[rng.randrange(len(s))] = rng.choice("abc")
        text = f"{''.join(rng.choice('abd ') for _ in range(rng.randint(0, 30)))} {''.join(s)} {''.join(rng.choice('abd ') for _ in range(9))}"
        plain = "".join(map(chr, normalise(text)[0]))
        got = {}
        for p in tiers:
            for _, item, _, _, edits in p.matches([text]):
                got[p.ids[item]] = min(edits, got.get(p.ids[item], 99))
        for j, (p, k) in whole.items():
            passage = "".join(map(chr, p.codes[k]))
            if p.edits[k]:
                d = fewest_edits(passage, plain)
                assert got.get(j) == (d if d <= p.edits[k] else None)
            else:  # whole words, unchanged
                places = [a for a in range(len(plain)) if plain.startswith(passage, a)]
                stands = any(not (a and plain[a - 1].isalnum()) and not plain[a + len(passage) : a + len(passage) + 1].isalnum() for a in places)
                assert got.get(j) == (0 if stands else None)


def test_decontamination_tables(spark):
    passage = "A passage of the benchmark that is long enough to be told apart from chance."
    bench = spark.createDataFrame([(10, passage), (11, None), (12, ""), (13, "short"), (14, passage), (15, "a bc")], "item_id bigint, text string")
    rows = [(1, f"before {passage.upper()} after"), (2, "clean words only"), (3, None), (4, ""), (1, passage), (None, passage.replace("long", "lang")), (6, LONG + passage + LONG)]
    got = sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in benchmark_overlaps(docs(spark, rows), bench).collect())
    assert got == sorted((d, i, e) for d, e in (("1", 0), ("1", 0), ("None", 1), ("6", 0)) for i in (10, 14))
    for more in (1, 3):
        blocks = benchmark_overlaps(docs(spark, rows), bench, block_chars=10, pass_blocks=more)
        assert sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in blocks.collect()) == got
    tiny = benchmark_overlaps(docs(spark, [(1, "this is short and a bc"), (2, "shorter, a bcd")]), bench)
    assert sorted((r["doc_id"], r["item_id"], r["begin"], r["end"]) for r in tiny.collect()) == [(1, 13, 8, 13), (1, 15, 18, 22)]
    assert sorted(r["doc_id"] for r in drop_contaminated(docs(spark, rows), bench, block_chars=10, pass_blocks=1).collect()) == [2, 3, 4]
    kept = drop_contaminated(docs(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4] and kept.columns == docs(spark).columns
    assert benchmark_overlaps(docs(spark, rows), bench.limit(0)).count() == 0 == benchmark_overlaps(docs(spark, []), bench).count()


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


def test_simhash(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(400)]
    rows = list(TEXTS)
    for i in range(60):
        w = list(base)
        for _ in range(i // 12):
            w[rng.randrange(400)] = "changed"
        rows.append((100 + i, " ".join(w)))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    expect = sorted((str(i), f"{fps[k]:016x}", str(want[k])) for k, (i, _) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == expect
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(str(i) for i in ids) == sorted({str(v) for v in want.values()}) and kept.columns == docs(spark).columns
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_large_blocks_and_lanes(spark):
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(500)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint").cache()
    want = brute_components(signed, [f & (2**64 - 1) for f in signed])
    expect = {}
    for k, f in enumerate(signed):
        expect.setdefault(want[k], set()).add(f)
    for rows, dense, split in ((32, 2048, 10**6), (1024, 1, 10**6), (32, 2048, 40), (1024, 2048, 2), (8, 1, 20)):
        old, simhash.lane_count.__defaults__ = simhash.lane_count.__defaults__, (dense,)
        try:
            links = simhash.near_links(df, 3, tile_rows=rows, split_rows=split)
            found = {}
            for r in simhash.components(links).collect():
                found.setdefault(r["root"], set()).add(r["node"])
        finally:
            simhash.lane_count.__defaults__ = old
        assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in expect.values() if len(g) > 1)


def test_simhash_lone_pair_in_a_large_block(spark):
    rng = random.Random(12)
    # one lane is shared by all; the pair is 3 bits apart, one in each other lane, with the least bit counts of the block
    crowd = {0xABCD | sum(1 << b for b in rng.sample(range(16, 64), 24)) for _ in range(100)}
    pair = (0xABCD, 0xABCD | 1 << 20 | 1 << 40 | 1 << 60)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in (*crowd, *pair)], "fp bigint").cache()
    for rows, split in ((8, 10**6), (32, 10**6), (8, 16), (1024, 16)):
        assert pair in {(r["a"], r["b"]) for r in simhash.near_links(df, 3, tile_rows=rows, split_rows=split).collect()}


def test_null_ids_go_one_by_one(spark):
    rows = [(1, "one long text of some words"), (None, "one long text of some words"), (None, "quite another thing, seen once"), (None, None)]
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("1", rows[0][1]), ("None", "None"), ("None", rows[2][1])]
    assert kept.columns == docs(spark).columns


def test_lanes_follow_the_table():
    assert simhash.lane_count(10**5, 3) == 4 and simhash.lane_count(10**12, 3) > simhash.lane_count(10**9, 3) > 4


def test_toxicity(spark):
    rng = random.Random(13)
    calm = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(calm) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["idiot", "stupidish", "stupidly"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(5000, "you are an ID10T, " + " ".join(calm[:20])), (5001, None), (5002, ""), (5000, "іdіоt " + " ".join(calm[:20])), (None, "calm"), (5003, LONG)]
    lab = spark.createDataFrame([*labels, (None, 1), (7777, None), (0, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs(spark, rows), lab, least_docs=5).collect()
    by = {r["doc_id"]: r for r in got}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    right = sum(by[i]["predicted"] == (i % 6 == 0) for i in held)
    assert right / len(held) > 0.98 and all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    assert [r["predicted"] for r in got if r["doc_id"] == 5000] == [1, 1]
    assert by[5001]["predicted"] == by[5002]["predicted"] == by[None]["predicted"] == by[5003]["predicted"] == 0
    kept = toxicity.drop_toxic(docs(spark, rows), lab, least_docs=5)
    assert kept.where("doc_id = 5000").count() == 0 and kept.where("doc_id = 5001").count() == 1 and kept.columns == docs(spark).columns
    none = toxicity.toxicity(docs(spark), lab.limit(0))
    assert {r["score"] for r in none.collect()} == {0.0} and toxicity.toxicity(docs(spark, []), lab).count() == 0


def test_folding():
    want = {"you 东idiot now": "you 东 idiot now", "i.d.i.o.t": "idiot", "I D 1 0 T!": "idiot", "a b": "a b", "І-D-І-О-Т x y": "idiotxy", "𝐈𝐝𝐢𝐨𝐭": "idiot", "id\u200biot": "idiot", "😀idiot😀": "idiot", "": "", "...": ""}
    assert {t: " ".join(toxicity.fold(t)) for t in want} == want


def brute_strength(lex, text):
    words = toxicity.fold(text)
    line, hits = f" {' '.join(words)} ", {}
    for at in range(len(line)):
        found = [w for e, w in lex.weights.items() if line.startswith(e, at)]
        if found and not any(line.startswith(x, b) for x in lex.exceptions for b in range(max(0, at - len(x) + 2), at + 1)):
            hits[at] = max(found)
    return sum(hits.values()) / math.sqrt(len(words) + 1) if words else 0.0


def test_toxicity_against_a_naive_search():
    rng = random.Random(14)
    for _ in range(200):
        word = lambda n=5: "".join(rng.choice("abé1") for _ in range(rng.randint(1, n)))
        folded = lambda n=5: " ".join(toxicity.fold(word(n))) or "a"
        weights = {rng.choice([" {} ", " {}"]).format(folded()): rng.uniform(1, 6) for _ in range(6)}
        lex = toxicity.Lexicon(weights, [f" {folded()} {folded()} " for _ in range(3)] + [f" {folded()} "])
        text = " ".join(word(7) for _ in range(rng.randint(0, 60)))
        assert lex.strength(text) == pytest.approx(brute_strength(lex, text))
        z = lex.bias + lex.slope * math.log1p(10 * lex.strength(text))
        assert lex.score(text) == pytest.approx(1 / (1 + math.exp(-z)))


def test_the_sample_is_bounded_by_rows(spark):
    rows = [(i % 5, f"text {i}") for i in range(100)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(0, 1)], "doc_id bigint, toxic int")
    got = toxicity.labelled_sample(docs(spark, rows), lab, 2, "doc_id", "text", "toxic").collect()
    assert len(got) == 2 and len(toxicity.labelled_sample(docs(spark, rows), lab, 99, "doc_id", "text", "toxic").collect()) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(5))


def test_toxicity_exceptions():
    lex = toxicity.Lexicon({" trash ": 5.0}, [" trash can "], bias=-4, slope=4)
    assert lex.strength("put it in the trash can") == 0 < lex.strength("you trash") == lex.strength("YOU TR4$H")


def test_licenses(spark):
    import re

    rows = [
        *TEXTS,
        (20, "MIT license. Released under the MIT License.\nGNU GENERAL-PUBLIC license"),
        (21, "cc by cc by nc: Licensed under CC BY-NC 4.0. die tzente in mit license"),
        (22, "Licensed under the Apache License, Version 2.0. " * 40),
        (23, "Apacheé License; all rights reserved"),
        (24, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. THE SOFTWARE IS PROVIDED"),
        (25, "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the Big Project nor the names of its contributors may be used to endorse or promote products"),
        (26, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License; it is GPLv3. gplv3 or later. Licensed under GPL v3"),
        (27, "You may not use this file except in compliance with the License. \x01odd\x02 MIT LICENSE\x02"),
        (28, "all rights reserved " * 300 + "licensed under the mit license " * 300),
        (29, "MIT LİCENSE, mit\u212a license, \u212a, ÉCOLE mit license"),
        (None, "mit license"),
    ]
    got = sorted(licenses.license_scan(docs(spark, rows)).collect(), key=lambda r: str(r["doc_id"]))
    table = licenses.signatures()
    want = []
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        norm = f" {' '.join(words)} "
        det = [(norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" "), r.priority, r.number, r.label) for r in table for m in re.finditer(r.regex, norm)]
        beaten = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or (e[:2] == d[:2] and e[3] < d[3])))
        kept = [d for d in det if not any(beaten(d, e) for e in det)]
        want.append((str(i), len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in kept})), max((d[2] for d in kept), default=0) / 100, sorted(kept)))
    as_row = lambda r: (str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"], sorted(map(tuple, r["detections"])))
    assert sorted(map(as_row, got), key=repr) == sorted(want, key=repr)
    found = {r["doc_id"]: r["labels"] for r in got}
    assert found[24] == "mit" and found[25] == "bsd,bsd-3-clause" and found[26] == "gpl" and found[27] == "apache,mit"
    assert len(table) > 400 and licenses.license_scan(docs(spark, [])).count() == 0


def mention(rng, parsed):
    """A text that a parsed regular expression matches."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            one = rng.choice(arg)
            out += chr(one[1]) if str(one[0]) == "LITERAL" else "1"
        elif op == "BRANCH":
            out += mention(rng, rng.choice(arg[1]))
        elif op == "SUBPATTERN":
            out += mention(rng, arg[3])
        elif op == "MAX_REPEAT":
            out += "".join(mention(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def test_every_mention_of_a_license_has_its_keyword():
    import re

    rng = random.Random(4)
    for rule in licenses.signatures():
        for _ in range(20):
            text = mention(rng, re._parser.parse(rule.regex))
            assert re.search(rule.regex, f" {text} "), (rule, text)
            assert rule.keyword in text.split() and set(text.split()) & set(licenses.ADMITTING), (rule, text)


def test_licenses_without_a_gate(spark):
    import re

    rows = [(30, "the GNU Library General Public License"), (31, "Expat License"), (32, "Creative Commons Zero"), (33, "Open Data Commons"), (34, "Do What The Fun You Want To Public License"), (35, "may not be copied without")]
    for r in licenses.license_scan(docs(spark, rows)).collect():
        norm = f" {dict(rows)[r['doc_id']].lower()} "
        want = {x.label for x in licenses.signatures() if re.search(x.regex, norm)}
        assert want and set(r["labels"].split(",")) == want and r["score"] > 0, r


def test_packing(spark):
    t = Tokenizer.from_file(WORD)
    got = pack(docs(spark), WORD, capacity=256).collect()
    want = []
    for i, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(str(i), p, at, np.array(ids[at : at + 256], "<u4").tobytes()) for p, at in enumerate(range(0, len(ids), 256))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], bytes(r["ids"])) for r in got) == sorted(want)
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) == math.ceil(sum(r["length"] for r in got) / 256)
    seqs = sequences(pack(docs(spark), WORD, capacity=256)).collect()
    assert len(seqs) == len(bins) and all(len(s["ids"]) <= 1024 for s in seqs)
    shuffled = pack(docs(spark), WORD, capacity=256, most_offsets=1).collect()
    assert len(shuffled) == len(got) and len({r["sequence_id"] for r in shuffled}) == len(bins)
    assert len({(r["sequence_id"], r["offset"]) for r in shuffled}) == len(got)
    assert pack(docs(spark, []), WORD).count() == 0


def test_minimum_bin_slack_fills():
    rng = random.Random(17)
    for _ in range(30):
        counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        plan = minimum_bin_slack(counts, 100)
        size = np.zeros(plan.bins, int)
        for length, n in counts.items():
            b, o = plan.place(np.full(n, length), np.arange(n))
            np.add.at(size, b, length)
            assert (o >= 0).all()
        assert size.max() <= 100 and (size > 0).all()


def best_fit_bins(counts, capacity):
    room = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        at = bisect.bisect_left(room, x)
        left = (room.pop(at) if at < len(room) else capacity) - x
        bisect.insort(room, left)
    return len(room)


def test_never_more_bins_than_best_fit():
    rng = random.Random(18)
    saved = 0
    for i in range(60):
        low, high = ((1, 4096), (300, 2600), (800, 2000), (1000, 4096), (1, 60))[i % 5]
        counts = {rng.randint(low, high): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
        want = best_fit_bins(counts, 4096)
        assert sum(t for _, t in packing.best_fit(counts, 4096)) == want
        plan = minimum_bin_slack(counts, 4096)
        assert plan.bins <= want
        saved += want - plan.bins
        size = np.zeros(plan.bins, int)
        for length, n in counts.items():
            np.add.at(size, plan.place(np.full(n, length), np.arange(n))[0], length)
        assert size.max() <= 4096 and size.min() > 0
    assert saved > 0


def rule_fits(rule, host, path):
    def begins(p, s):
        if not p or p == "|":
            return not p or not s
        if p[0] == "*":
            return any(begins(p[1:], s[i:]) for i in range(len(s) + 1))
        if p[0] == "^":
            return begins(p[1:], s[1:]) and not (s[:1].isascii() and s[:1].isalnum() or s[:1] in ("-", "."))
        return s[:1] == p[0] and begins(p[1:], s[1:])

    labels = host.split(".")
    return begins(rule.path, path) and (not rule.host or any(fnmatch.fnmatchcase(".".join(labels[i:]), rule.host) for i in range(len(labels))))


def test_urls(spark):
    urls = ["https://a.COM/en/x?q#f", "http://example.com/en/7x", "http://example.com/en/8", "https://example.net/de/8", "ftp://x.net/de/", "http://b.org/es", "http://b.org/es/", None, "", "no scheme", "http://", "http://h.de/ads/1", "http://poker/", "http://h.de?x/en/", "http://notcom/en/", "http://example.com/en/7x", "http://m.casino-win.example.com/x", "http://free-bets.example.com/", "http://essex.ac.uk/a.pdf", "http://a.de/a.pdf/b", "http://a.de/x/a.pdf?b", "http://a.de/wp-content/uploads/1", "http://a.de/wp-content/1", "http://a.de/b/wp-login.php", "http://a.de/wp-login.phpx", "http://a.de/wp-login.php/x", "http://a.de/ajax/z/load", "http://a.de/ajax/z/y/load!", "http://x.doubleclick.net", "http://poker.a.de/", "http://a.de/sitemap.xml", "http://a.de/x.xml", "http://A.de/ADS/1", "http://a.de/go/to/", "http:///ads/"]
    df = spark.createDataFrame([(i if i != 3 else None, u, "x", "x", "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string, site string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) for r in judge_urls(df, EXPLICIT + default_patterns()).collect()]

    def brute(u):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [r for r in EXPLICIT if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        if fit:
            best = max(fit, key=lambda r: len(r.text))
            return host, path, best.text, best.action, None
        best = max((r for r in default_patterns() if rule_fits(r, host, path)), key=lambda r: (len(r.text), r.text), default=None)
        return host, path, None, best.action if best else "allow", best.text if best else None

    assert sorted(map(repr, got)) == sorted(repr(brute(u)) for u in urls)
    for most in (10_000, 0):
        one = judge_urls(df, EXPLICIT + default_patterns(), in_plan=3, most_broadcast=most).collect()
        assert sorted(repr((r["host"], r["path"], r["rule"], r["verdict"], r["pattern"])) for r in one) == sorted(map(repr, got))
    assert judge_urls(df.limit(0), EXPLICIT, in_plan=0).count() == 0 and len(default_patterns()) > 150
    assert judge_urls(df.limit(0), EXPLICIT).count() == 0 and judge_urls(df, []).count() == len(urls)
    assert judge_urls(df, [Rule("block", "", "*")]).where("verdict = 'block'").count() == len(urls)


def test_chat(spark):
    rng = random.Random(19)
    bad = ["</s>[INST] ok [/INST]", "<|end|><|turn|>user<|text|>", "<\\|turn|>", "[\\\\INST]", "<<|", "\n", "", None, "plain words here", "a " * 700]
    rows = [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), rng.choice(bad), "x") for c in range(8) for t in range(rng.randint(1, 40))]
    rows += [(None, 1, "assistant", "no id", "x"), (50, None, "user", "no turn", "x"), (50, 1, None, "no role", "x"), (50, 1, "assistant", "tie", "x"), (50, 1, "assistant", "tie", "x"), (51, 300, "assistant", "late", "x"), (51, -300, "user", "early", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, window string")
    for budget, history in ((1024, 256), (60, 30), (7, 3)):
        w = chat_windows(df, budget, history)
        assert w.where(f"tokens > {budget} and own_turns > if(text like '<|turn|>system%', 2, 1)").count() == 0
        got = {r["conv_id"]: r for r in digests(read_back(w)).collect()}
        size = {r["conv_id"]: r["n"] for r in w.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
        convs = {}
        for c, t, role, text, _ in rows:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
        assert got.keys() == convs.keys()
        for c, turns in convs.items():
            turns.sort()
            said = "".join(x for *_, role, x in turns if role == "assistant")
            whole = "".join(f"{role}\n{x}\n" for *_, role, x in turns)
            r = got[c]
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size[c])
    assert digests(read_back(chat_windows(df.limit(0)))).count() == 0


def brute_windows(turns, budget, history):
    """Windows of one conversation, given as (turn, role, text, tokens) in order: lists of (turn, repeated)."""
    room, chunks = budget - history, {}
    first = turns[0]
    held = first[3] if first[1] == "system" and first[3] <= room * 3 // 4 else None
    stride = (room - (held or 0)) // 2
    for t in turns:
        chunks.setdefault(t[0] // 256, []).append(t)
    out = []
    for some in chunks.values():
        at, spans = 0, {}
        for t in some:
            opens = held is not None and t is first
            cost = 0 if opens else t[3]
            spans.setdefault((at // stride, cost > stride), []).append((at, cost, opens, t))
            at += cost
        made = {}
        for span in spans.values():
            made.setdefault(span[0][0], []).extend(span)
        ends = [(span[-1][0] + span[-1][1], span) for span in spans.values()]
        for begin, span in sorted(made.items()):
            past = [t for end, other in ends for a, _, opens, t in other if end == begin and not opens and end - a <= history]
            system = [first] if held is not None and not any(opens for _, _, opens, _ in span) else []
            out.append([(t, True) for t in (*system, *past)] + [(t, False) for *_, t in span])
    return out


def test_chat_windows_keep_their_budget(spark):
    rng = random.Random(20)
    say = lambda n: " ".join("w" for _ in range(n))
    convs = {1: [5000] + [200] * 40, 2: [300] + [200] * 40, 3: [20] + [rng.randint(1, 900) for _ in range(60)], 4: [2] * 700, 5: [600, 2000, 1, 2000, 1, 1], 6: [10]}
    rows = [(c, t, "system" if t == 0 else ("user", "assistant")[t % 2], say(n)) for c, sizes in convs.items() for t, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat_windows(df).orderBy("conv_id", "window").collect()
    want = []
    for c in convs:
        turns = [(t, role, text, len(text.split()) + 5) for k, t, role, text in rows if k == c]
        want += [(c, "".join(f"<|{'again' if again else 'turn'}|>{t[1]}<|text|>{t[2]}<|end|>" for t, again in w), sum(t[3] for t, _ in w), sum(not again for _, again in w)) for w in brute_windows(turns, 1024, 256)]
    assert [(r["conv_id"], r["text"], r["tokens"], r["own_turns"]) for r in got] == want
    assert all(r["tokens"] <= 1024 or r["own_turns"] <= 1 + (r["text"].startswith("<|turn|>system")) for r in got)
    assert all("system" in r["text"] for r in got if r["conv_id"] in (2, 3, 4)) and sum("system" in r["text"] for r in got if r["conv_id"] == 1) == 1


def test_top_k(spark):
    rng = np.random.default_rng(21)
    rows = [(i, rng.normal(0, 1 + i % 3, 8).astype("float32").tolist(), "x") for i in range(400)]
    rows += [(401, rows[5][1], "x"), (402, rows[5][1], "x"), (403, None, "x"), (404, [1.0, None, 2.0], "x"), (405, [float("nan")] * 8, "x"), (406, [float("inf")] + [0.0] * 7, "x"), (407, [], "x"), (408, [3.0, 1.0], "x"), (409, [1.0] * 12, "x"), (None, [1.0] * 8, "x"), (50, rows[50][1], "x"), (7, rows[9][1], "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, qv in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in good if i != q)[:5]
        want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s)]
    for kw in ({}, {"query_block": 3, "sample_rows": 4, "pivots": 2}):
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), **kw).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    few = df.where("vec_id in (50, 1, 2)")
    assert topk.top_k(few, few.where("vec_id = 50")).count() == 2
    assert topk.top_k(df.limit(0), df).count() == 0 == topk.top_k(df, df.limit(0)).count()
    huge = spark.createDataFrame([(50, [3e38] * 4), (1, [3e38] * 4), (2, [-3e38] * 4)], "vec_id bigint, embedding array<float>")
    assert [r["score"] for r in topk.top_k(huge, huge.where("vec_id = 50")).orderBy("rank").collect()] == [2**63 - 1, -(2**63)]
