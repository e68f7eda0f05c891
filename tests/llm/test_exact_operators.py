"""Operators with exact contracts, held against brute force on odd little tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest

from civicspark.llm import decontaminate, licenses, media, mixing, near_dedup, pii, suffix_dedup

LOW = {i: i + 32 for i in range(65, 91)}
ODD = "doc_id long, text string, lang string, source string, n_chars long, grp long, salt string, size string, label string, comp int"


def odd_rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(300)]
    texts = [None, "", " ", "\n\t", "a", "a b", "A b", "!!!", "x" * 5000, "ab " * 3000, "ab " * 3000, "0 1 2 3 4 5 6 7 8 9", " ".join(base), " ".join(base).upper()]
    for k in range(12):  # near copies at several distances
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += ["intro " + " ".join(base[40:70]) + " end", " ".join(word() for _ in range(400)), "".join(rng.choice("ab") for _ in range(400)) * 3, "é" * 60, "é" * 61]
    return [(i * 3 - 9, t, "en", ["s1", "s2", None][i % 3], 0, 1, "x", "y", "z", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def sets(rows, width):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("width", "part"), [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(odd, width, part):
    own = sets([(r[0], r[1]) for r in odd_rows()], width)
    comp = {i: i for i in own}
    for _ in own:
        for a in own:
            for b in own:
                both = len(own[a] & own[b])
                if both and 100 * both >= part * (len(own[a]) + len(own[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: r for r in near_dedup.near_duplicates(odd, width, part).collect()}
    assert {i: (len(s), comp[i], comp[i] == i) for i, s in own.items()} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_near_duplicates_across_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_dedup, "STREAM_ROWS", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SKETCHES", 4)
    want = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(odd, 3, 85).collect()}
    monkeypatch.undo()
    assert want == {r.doc_id: r.component_id for r in near_dedup.near_duplicates(odd, 3, 85).collect()}


def test_near_duplicates_of_repeated_ids_and_nothing(spark, odd, empty):
    own = lambda df: sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())
    once = own(near_dedup.near_duplicates(odd, 3, 85))
    assert own(near_dedup.near_duplicates(odd.unionByName(odd), 3, 85)) == sorted(once * 2)
    assert near_dedup.near_duplicates(empty, 3, 85).count() == 0


def test_near_duplicates_without_ids_and_with_other_texts_of_an_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(3)), (3, text(1)), (3, text(2)), (None, text(2)), (None, text(4)), (None, text(4)), (None, None), (None, ""), (8, None)]
    for given in (rows, rows[::-1]):
        found = near_dedup.near_duplicates(spark.createDataFrame(given, "doc_id long, text string"), 3, 85).collect()
        got = sorted(str((r.doc_id, r.component_id, r.kept)) for r in found)
        want = [(1, 1, True), (2, 2, True), (3, 1, False), (3, 3, True), (None, 3, False), (None, None, True), (None, None, False), (None, None, True), (None, None, True), (8, 8, True)]
        assert got == sorted(map(str, want)) and sum(r.first for r in found) == 7


def test_near_duplicates_of_a_whole_table_match_all_pairs(spark):
    """Recall over every linked pair: the components equal those of an inverted index over all shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for width, part in ((3, 85), (5, 80)):
        own = sets([(r.doc_id, r.text) for r in docs.collect()], width)
        comp = {i: i for i in own}

        def root(x, comp=comp):
            while comp[x] != x:
                x = comp[x]
            return x

        holds = collections.defaultdict(list)
        links = 0
        for i in sorted(own):
            shared = collections.Counter(j for x in own[i] for j in holds[x])
            for j, both in shared.items():
                if 100 * both >= part * (len(own[i]) + len(own[j]) - both):
                    links += 1
                    a, b = root(i), root(j)
                    comp[max(a, b)] = min(a, b)
            for x in own[i]:
                holds[x].append(i)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, width, part).collect()}
        assert links > 50 and got == {i: root(i) for i in own}


def test_screening_emits_no_more_links_than_join_a_block(spark):
    rows = [(1, 0, side, d, d // 2, [0] * near_dedup.SKETCH_WORDS) for side in (0, 1) for d in range(200)]
    rows += [(1, 0, side, d, d, [-1] * near_dedup.SKETCH_WORDS) for side in (0, 1) for d in (500, 501)] + [(2, 0, 0, 9, 9, [0] * near_dedup.SKETCH_WORDS)]
    found = near_dedup.screen(spark.createDataFrame(rows, "grp long, salt long, side int, doc long, comp long, sketch array<long>"), 10).collect()
    links = [(r.u, r.v) for r in found if r.v is not None]
    assert len(links) == 100 and {x for p in links for x in p} == {*range(100), 500, 501}
    assert {r.u for r in found if r.v is None} == {*range(200), 500, 501}


def test_odd_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    for similarity in (0.8, 0.9, 0.95):
        gaps = []
        for _ in range(40):
            n = 2000
            shared = int(n * 2 * similarity / (1 + similarity))
            x = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
            a, b = np.sort(x[:n]), np.sort(x[n - shared :])
            bits = np.bitwise_count(near_dedup.odd_sketch(near_dedup.min_hashes(a)).view(np.uint64) ^ near_dedup.odd_sketch(near_dedup.min_hashes(b)).view(np.uint64)).sum()
            gaps.append(near_dedup.estimate_from_bits(bits) - similarity)
        assert abs(np.mean(gaps)) < 0.03 and np.min(gaps) > -near_dedup.MARGIN


@pytest.mark.parametrize("batch", [8 << 20, 3000])
def test_substrings_match_brute_force(odd, monkeypatch, batch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch)
    got = {r.doc_id: (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.substring_dedup(odd).collect()}
    want = {w[0]: w for w in suffix_dedup.brute_force([(r[0], r[1]) for r in odd_rows()])}
    assert got == want


def test_substrings_across_segments(monkeypatch):
    import numpy as np

    data = np.frombuffer(("".join(random.Random(5).choice("abc") for _ in range(3000))).encode(), np.uint8)
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    parts = suffix_dedup.anchors(data)
    windows = lambda x: {p: int(at) for first, last, at in zip(*x[:3], strict=True) for p in range(first, last + 1)}
    assert windows(whole) == windows(parts) and len(windows(whole)) == len(data) - suffix_dedup.LENGTH + 1


def test_substrings_null_id_same_id_and_nothing(spark, empty):
    text = "the quick brown fox jumps over the lazy dog and runs away again"
    rows = spark.createDataFrame([(None, text), (4, text), (4, text), (5, text)], "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_removed) for r in suffix_dedup.substring_dedup(rows).collect())
    assert got == [(-1, 0), (4, 0), (4, 0), (5, len(text))]
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.substring_dedup(rows, texts=True).collect()}
    assert kept[5] == b"" and kept[4] == text.encode()
    assert suffix_dedup.substring_dedup(empty).count() == 0


def test_decontamination_matches_brute_force(spark, odd, empty):
    words = odd_rows()[12][1].split()
    items = [(1, " ".join(words[40:60])), (2, "A b"), (3, None), (4, ""), (5, " ".join(words[50:80]).upper()), (6, "0 1 2"), (10, "ab ab ab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.brute_force([(r[0], r[1]) for r in odd_rows()], items))
    digest = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    for size in (100_000, 7):
        got = sorted((r.doc_id, r.n_words, r.n_hit, len(r.item_ids), digest(r.item_ids), r.contaminated) for r in decontaminate.contamination(odd, bench, size).collect())
        assert got == want
    nameless = decontaminate.contamination(odd, spark.createDataFrame([(None, items[0][1]), (1, items[0][1])], "item_id long, text string")).where("n_hit > 0").collect()
    assert nameless and all(r.item_ids == ["1"] for r in nameless)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_private_base_spans_match_plain_patterns(spark, odd, empty):
    cases = [
        "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3", "4" * 3000, "a@" + "b.c." * 500, "x" * 5000, "1 " * 2000, "é🎉 a.b@c.de +1 (555) 123-4567, 4111 1111 1111 1111, 4111-1111-1111-1112",
        "+1+12345678 +49 30 1234567-", "a.b+c%d@e-f.g.h@i.j", "@@ a@ @b.c a@b..c", None, "",
    ]
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = pii.find_private(rows)
    got = {r.doc_id: r.b for r in found.select("doc_id", pii.joined("base").alias("b")).collect()}
    assert got == {i: ",".join(f"{k}:{s}:{e}" for k, s, e in pii.brute_force(t)[0]) for i, t in enumerate(cases)}
    assert pii.redact(empty).count() == 0 and pii.redact(odd).columns == odd.columns
    assert pii.redact(rows.where("doc_id = 0")).first().text == "[EMAIL][EMAIL] x@y"


def test_private_boosting_adds_spans(spark):
    rng = random.Random(2)
    rows = [(i, f'word token = "{rng.getrandbits(160):040x}" more') for i in range(60)] + [(100 + i, "plain " + "abcdefgh" * 3) for i in range(60)]
    # the label of a run is its context and its features are its format: the same format elsewhere is found too
    rows += [(200 + i, f"see {rng.getrandbits(160):040x} there") for i in range(20)]
    rows += [(300 + i, f"call {'+1 ' if i % 2 else ''}(555) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} now") for i in range(60)]
    rows += [(400 + i, f"invoice {rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)} paid") for i in range(60)]
    found = {r.doc_id: r.s for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined("spans").alias("s")).collect()}
    assert all(found[i] == "secret:14:54" for i in range(60)) and not any(found[100 + i] for i in range(60))
    assert all(found[200 + i] == "secret:4:44" for i in range(20))
    # numbers without a plus sign where those with one stand, and none where they never do
    assert all(found[300 + i] == ("phone:5:22" if i % 2 else "phone:5:19") for i in range(60))
    assert not any(found[400 + i] for i in range(60))


def made_key(rng, kind):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n - 2)) + "7q"
    return {"forge": "ghp_" + some(36), "chat": f"xoxb-{rng.randrange(10**11, 10**12)}-{some(24)}", "base64": f"{some(14)}/{some(12)}+{some(14)}==", "dotted": f"{some(20)}.{some(40)}.{some(30)}"}[kind]


def test_private_keys_are_whole_runs(spark):
    rng = random.Random(4)
    kinds = ("forge", "chat", "base64", "dotted")
    keys = {i: made_key(rng, kinds[i % 4]) for i in range(240)}
    # two thirds are assigned to a name; the last third only stands in the text
    rows = [(i, f"set api_key={k} and go" if i < 160 else f"we saw {k} there") for i, k in keys.items()]
    words = ["a-fairly-long-hyphenated-word", "north_and_south_of_the_river", "docs/guide/of/the/library", "and.so.it.goes.on.and.on", "well-known/but-plain"]
    rows += [(1000 + i, f"read {words[i % 5]} page {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.s for r in pii.find_private(docs).select("doc_id", pii.joined("spans").alias("s")).collect()}
    at = {i: (t.index(keys[i]), t.index(keys[i]) + len(keys[i])) for i, t in rows if i in keys}
    caught = {i for i, (s, e) in at.items() if f"secret:{s}:{e}" in found[i].split(",")}
    assert len(caught & set(range(160))) == 160 and len(caught - set(range(160))) >= 0.9 * 80
    assert not any(found[1000 + i] for i in range(200))
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(texts[i] == ("set api_key=[SECRET] and go" if i < 160 else "we saw [SECRET] there") for i in caught)


def test_known_prefixes_are_labels(spark):
    rng = random.Random(5)
    rows = [(i, f"here {made_key(rng, 'forge')} now") for i in range(100)] + [(200 + i, f"see plain-words-{i % 9}-of-a-long-kind ok") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(texts[i] == "here [SECRET] now" for i in range(100))
    assert all(texts[200 + i] == rows[100 + i][1] for i in range(100))


def test_long_joined_runs_take_linear_time(spark):
    texts = ["a-" * 200_000, "1_" * 200_000 + "a", "x/" * 100_000 + "9" * 100_000, "." * 300_000 + "ab12" * 10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.find_private(docs).count() == 4


def plain_score(model, x):
    total = model.bias
    for (f, v), leaves in model.trees:
        cut, values = leaves[0] if x[f] <= v else leaves[1]
        total += values[0] if cut is None or x[cut[0]] <= cut[1] else values[1]
    return total


def test_added_spans_match_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    counts = pii.combination_counts(pii.with_spans(docs))
    model = pii.Boosted(counts)
    got = {r.doc_id: r.s for r in pii.find_private(docs).select("doc_id", pii.joined("spans").alias("s")).collect()}
    cue = lambda before: next((k + 1 for k, words in enumerate(pii.CUES) if re.search(rf"(?i)(?:{words})[^A-Za-z0-9]*$", before)), 0)
    kind_of = lambda c: 0 if not c or c.isspace() else 1 if re.match("[A-Za-z0-9]", c) else 2 if c in "\"'=:" else 3 if c in ".,;!?" else 4
    seen = 0
    for r in docs.collect():
        text = r.text or ""
        base = pii.brute_force(text)[0]
        spans = {(pii.KINDS.index(k), s, e) for k, s, e in base}
        for pattern, kind, needs in pii.GENERATORS:
            last = 0
            for m in re.finditer(pattern, text) if not needs or re.search("[0-9]", text) else ():
                x = dict.fromkeys(pii.FEATURES, 0) | {"k": pii.KINDS.index(kind)}
                before = re.sub(r"[\x20()+0-9-]*$", "", text[max(last, m.start() - 24) : m.start()])
                last = m.end()
                n, digits = len(m[0]), len(re.sub("[^0-9]", "", m[0]))
                if kind == "secret":
                    x |= {"size": sum(n >= t for t in (20, 32, 48)), "digits": 0 if not digits else 1 if digits * 8 < n else 2 if digits * 2 < n else 3, "hex": int(bool(re.fullmatch("[0-9A-Fa-f]+", m[0])))}
                    x["letters"] = 2 if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) else int(bool(re.search("[A-Z]", m[0])))
                    x["gaps"] = 3 if "." in m[0] else 2 if re.search("[/+]", m[0]) else int(bool(re.search("[_-]", m[0])))
                else:
                    x |= {"cue": cue(before), "before": kind_of(before[-1:]), "after": kind_of(text[m.end() : m.end() + 1]), "gaps": 3 if re.search("[./()]", m[0]) else 2 if "-" in m[0] else int(" " in m[0])}
                covered = any(s <= m.start() and m.end() <= e for _, s, e in base)
                if not covered and plain_score(model, x) >= model.thresholds[x["k"]]:
                    spans.add((x["k"], m.start(), m.end()))
                    seen += 1
        assert got[r.doc_id] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
    assert seen


def test_boosting_lowers_the_loss():
    import math

    rng = random.Random(1)
    rows = [dict.fromkeys(pii.FEATURES, 0) | {"aside": a, "k": k, "cue": c, "before": b, "n": 100, "yes": 90 if c == 1 and b else 5 + rng.randint(0, 3)} for a in (False, True) for k in (2, 3) for c in range(3) for b in range(2)]
    loss = lambda m: -sum(c["yes"] * math.log(p) + (c["n"] - c["yes"]) * math.log(1 - p) for c in rows for p in [1 / (1 + math.exp(-m.score(c)))])
    losses = [loss(pii.Boosted(rows, trees)) for trees in (0, 1, 5, 30)]
    assert losses == sorted(losses, reverse=True)
    model = pii.Boosted(rows)
    assert all((model.score(c) >= model.thresholds[c["k"]]) == (c["cue"] == 1 and c["before"] == 1) for c in rows)


def test_very_many_matches_and_clashing_names(spark):
    text = " ".join(f"a{i}@b.de 1.2.3.{i % 300}" for i in range(5000))
    rows = spark.createDataFrame([(1, text, "mine", 1, "x", "y", None)], "doc_id long, text string, base string, offered int, spans string, any_digit_in_text string, copy_no int")
    found = pii.find_private(rows.select("doc_id", "text")).select(pii.joined("base").alias("b")).first().b
    assert found == ",".join(f"{k}:{s}:{e}" for k, s, e in pii.brute_force(text)[0])
    out = pii.redact(rows).first()
    assert (out.base, out.offered, out.spans, out.any_digit_in_text, out.copy_no) == ("mine", 1, "x", "y", None)
    want = re.sub(r"a\d+@b\.de", "[EMAIL]", text)
    want = re.sub(r"1\.2\.3\.(\d+)", lambda m: "[IP]" if int(m[1]) <= 255 else m[0], want)
    assert out.text == want


def test_licences(spark, odd, empty):
    wrapped = lambda text, width, mark="": "\n".join(mark + " ".join(text.split()[i : i + width]) for i in range(0, len(text.split()), width))
    mit, isc, gpl2 = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["ISC"][1], licenses.TEMPLATES["GPL-2.0"][0]
    rows = [
        (1, "x\nReleased under the MIT License.\ny", ["MIT"]),
        (2, "this file was released UNDER the  mit license in the spring of the year", ["MIT"]),
        (3, "Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        (4, "under the sun", []),
        (5, None, []),
        (6, wrapped(isc, 9, "// "), ["ISC"]),
        (7, "Copyright 2020 Someone\n\n" + wrapped(mit, 12, " * ") + "\n*/ int main() {}", ["MIT"]),
        (8, "intro words " * 300 + mit.replace("sublicense, ", "").replace("persons", "people") + " and more" * 300, ["MIT"]),
        (9, gpl2 + " Some other words between. " + licenses.TEMPLATES["GPL-3.0"][0], ["GPL-2.0", "GPL-3.0"]),
        (10, gpl2, ["GPL-2.0"]),
        (11, wrapped(licenses.TEMPLATES["BSD-3-Clause"][1], 10), ["BSD-3-Clause"]),
        (12, wrapped(licenses.TEMPLATES["BSD-2-Clause"][1], 10), ["BSD-2-Clause"]),
        (13, "license", []),
        (14, "Permission is hereby granted to merge the permission of the software " * 50, []),
    ]
    rows += [(100 + i, text, [licence]) for i, (licence, text) in enumerate((k, t) for k, v in licenses.TEMPLATES.items() for t in v)]
    got = {r.doc_id: [(m.licence, m.dice) for m in r.matches] for r in licenses.licence_matches(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, text, want in rows:
        assert [name for name, _ in got[i]] == want
        every = licenses.brute_force(text)
        assert all(dice <= every[name] for name, dice in got[i])
        assert set(every) == set(want) or set(every) > set(want)  # what is left out lies under a better one
        if want:
            assert max(every.values()) == max(dice for _, dice in got[i]) or max(every.values()) < 1
    assert licenses.licence_matches(empty).count() == 0 and licenses.licence_matches(odd).count() == odd.count()


def test_needed_words_lose_no_match():
    known = licenses.known_templates(licenses.TEMPLATES)
    need = licenses.needed_words(known, 0.8)
    for t in known:
        without = [g for g in t["grams"] if not set(g.split()) & set(need)]
        assert len(without) < len(t["grams"]) * 0.8 / 1.2


def test_mixing_shares_and_repeats(spark, empty):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.randint(0, 60))), None if i % 7 == 0 else f"s{i % 3}") for i in range(900)] + [(-1, None, "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    sizes = {k: sum(r.size for r in v) for k, v in by.items()}
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(sizes.values()))
    for k, v in by.items():
        assert v[0].source_size == sizes[k] and v[0].target <= 3 * sizes[k] + 1e-6
        assert abs(sum(r.copies * r.size for r in v) - v[0].target) <= 0.05 * v[0].target + 60
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    emitted = mixing.emit_mix(docs)
    assert emitted.count() == sum(r.copies for r in got) and mixing.emit_mix(empty).count() == 0


def test_mixing_ranges_do_not_change_the_rank(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b", "s0" if i % 3 else "s1") for i in range(500)], "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 20)
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == want


def test_media_round_trip(odd, empty):
    for r in media.media_columns(odd).collect():
        text = next((x[1] or "").encode() for x in odd_rows() if x[0] == r.doc_id)
        payload = media.pad(text)
        assert media.from_wav(bytes(r.media)) == payload and len(payload) % 64 == 0 and payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(r.media)
        assert len(r.times) == len(r.codes) and r.times == sorted(r.times)
    assert media.media_columns(empty).count() == 0


def test_media_peak_pairs_match_plain_loops(odd):
    import numpy as np

    window = np.hanning(media.FRAME).astype(np.float32)
    seen = 0
    for r in media.media_columns(odd).collect():
        samples = np.frombuffer(media.from_wav(bytes(r.media)), np.uint8).astype(np.float32) - np.float32(128)
        peaks = []
        for frame in range(max(1, -(-(len(samples) - media.FRAME) // media.HOP) + 1)):
            own = np.zeros(media.FRAME, np.float32)
            part = samples[frame * media.HOP : frame * media.HOP + media.FRAME]
            own[: len(part)] = part
            power = np.abs(np.fft.rfft(own * window)).astype(np.float32)
            tops = [k for k in range(1, len(power) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > 1]
            peaks.append(sorted(sorted(tops, key=lambda k: (-power[k], k))[: media.PEAKS]))
        want = sorted((t, (a << 16) | (b << 4) | gap) for t, own in enumerate(peaks) for a in own for gap in range(1, media.REACH + 1) if t + gap < len(peaks) for b in peaks[t + gap])
        assert list(zip(r.times, r.codes, strict=True)) == want
        seen += len(want)
    assert seen > 1000


def test_media_fingerprints_of_a_shifted_clip_share_most_codes():
    import numpy as np

    rng = random.Random(6)
    clip = np.frombuffer("".join(rng.choice("abcdefgh ") for _ in range(20_000)).encode(), np.uint8)
    codes = lambda x: collections.Counter(media.peak_pairs(*media.spectral_peaks(x))[1].tolist())
    other = np.frombuffer("".join(rng.choice("abcdefgh ") for _ in range(20_000)).encode(), np.uint8)
    own, moved, far = codes(clip), codes(clip[5 * media.HOP :]), codes(other)
    assert sum((own & moved).values()) > 0.9 * sum(moved.values()) > 2 * sum((own & far).values())
