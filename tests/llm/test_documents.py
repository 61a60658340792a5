"""Quality rules, near-duplicates, fingerprints, licences, secrets and mixing
against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from odd_rows import prose

from martloom.llm import imatch, license, mixing, quality, secrets, simhash

SPACE, WORD = "[ \t-\r]", "[^\x20\x09-\x0D]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_of(text):
    w = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows, inside = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_base_statistics(docs, texts):
    got = quality.judge(docs).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    have = sorted(((r.doc_id, *(r[c] for c in quality.BASE), r.base_failed) for r in got), key=key)
    want = []
    for i, t in texts:
        b = base_of(t)
        want.append((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert have == sorted(want, key=key)
    assert all(not r.kept for r in got if r.base_failed)


def shared_by(rows, limit):
    """Normalised lines of each row, and the (host, line) that more than ``limit``
    different texts of a host hold; rows are (doc_id, host, text)."""
    norm = lambda x: re.sub(SPACE + "+", " ", re.sub("[0-9]", "0", x.strip(" \t\n\x0b\f\r").lower()))
    lines, held = [[norm(x) for x in t.split("\n") if re.search(WORD, x)] for _, _, t in rows], defaultdict(set)
    for (_, host, text), own in zip(rows, lines):
        for x in own:
            held[host, x].add(text)
    return lines, {x for x, texts in held.items() if len(texts) > limit}


def verdicts(rows, limit=3, left=0.3):
    """(doc_id, kept) by brute force."""
    out, (lines, shared) = [], shared_by(rows, limit)
    for k, (i, host, text) in enumerate(rows):
        b = base_of(text)
        gone = sum(len(x.split(" ")) for x in lines[k] if (host, x) in shared)
        out.append((i, not (b[0] < 50 or 100 * b[4] > 50 * b[0]) and b[0] - gone >= left * b[0]))
    return sorted(out)


def test_shared_lines_deplete_documents_and_copies_do_not(spark):
    bar = "Menu  Home 1 About | Contact and %s" % prose(99, 60)
    rows = [(i, "h", f"{prose(i, 12)}\n{bar}\n{prose(i + 50, 8)}") for i in range(8)]  # mostly the bar
    rows += [(10 + i, "h", f"{prose(i + 9, 300)}\n{bar}") for i in range(8)]  # the bar is a part
    rows += [(20 + i, "h", prose(77, 80) + "\n" + prose(78, 80)) for i in range(9)]  # copies
    rows += [(30, "other", f"{prose(5, 12)}\n{bar}"), (31, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted((r.doc_id, r.kept) for r in quality.judge(df, limit_docs=3).collect())
    want = verdicts([(i, h or "", t) for i, h, t in rows])
    assert got == want
    kept = {i for i, k in got if k}
    assert not kept & set(range(8)) and set(range(10, 18)) <= kept and set(range(20, 29)) <= kept and 30 in kept
    assert {r.doc_id for r in quality.keep_good(df, limit_docs=3).collect()} == kept


def test_shared_lines_leave_the_kept_texts(spark):
    """Brute force of the texts; columns that the operator could use itself stay."""
    bar = "Menu  Home 1 | %s" % prose(99, 20)
    rows = [(i, "h", f"{prose(i, 100)}\n\n{bar}\n{prose(i + 50, 40)}" if i % 2 else prose(i, 90)) for i in range(14)]
    odd = ["_raw", "_placed", "_text", "_id", "_key", "_shared_at", "row", "id", "key", "a`b.c"]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns(
        {c: F.lit(c) for c in odd}).withColumn("n_chars", F.length("text"))
    got = {r.doc_id: r for r in quality.keep_good(df, limit_docs=3).collect()}
    lines, shared = shared_by(rows, 3)
    assert len(got) == 14 and len(shared) == 1
    for i, host, text in rows:
        norm = iter(lines[i])
        left = [x for x in text.split("\n") if not re.search(WORD, x) or (host, next(norm)) not in shared]
        assert got[i].text == "\n".join(left) and got[i].n_chars == len(got[i].text)
        assert [got[i][c] for c in odd] == odd


def fingerprint(text):
    w = re.findall(WORD, text.translate(LOW))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def classes(values, near):
    """Smallest member of each component."""
    root = {v: v for v in values}
    for a in values:
        for b in values:
            if near(a, b):
                x, y = root[a], root[b]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return root


def test_fingerprints_and_components(docs, texts):
    some = [(i, t) for i, t in texts if len(t) < 10_000]
    got = simhash.groups(docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 10_000)).collect()
    prints = {i: fingerprint(t) for i, t in some}
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((i, prints[i]) for i, _ in some)
    root = classes(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    ids = defaultdict(list)
    for i, v in prints.items():
        ids[root[v]].append(i)
    want = {i: min((x for x in ids[root[v]] if x is not None), default=None) for i, v in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("field", [2, 3, 5])
def test_masks_cover_every_pair_of_bits(field):
    kept = simhash.masks(field)
    assert len(kept) == (field**3 - 1) // (field - 1)
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in kept)


@pytest.mark.parametrize("field", [2, 3])
def test_links_miss_no_pair(spark, field):
    r = np.random.default_rng(5)
    centres = r.integers(0, 2**63, 12, dtype=np.uint64)
    values = {int(c) for c in centres} | {0, 1, 3, 7, 2**63, 2**64 - 1}
    for c in centres:
        x = int(c)
        for _ in range(25):  # a chain of steps of at most two bits, and a crowd around the centre
            x ^= 1 << int(r.integers(64)) | 1 << int(r.integers(64))
            values |= {x, int(c) ^ 1 << int(r.integers(64))}
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in sorted(values)]
    df = spark.createDataFrame(signed, "fp long")
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    found = simhash.links(df, field).collect()
    assert all(near(x.a, x.b) for x in found)
    want = {k: v for k, v in classes([v for v, in signed], near).items()}
    got = {x.node: x.root for x in simhash.components(simhash.links(df, field)).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_one_document_of_each_group_stays(docs, spark):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 8 not in ids and ids.count(2) == 1 and 3 not in ids and None in ids
    # one row of a group, whatever repeats; names that the operator could use itself
    base, other = prose(1, 120), prose(2, 120)
    rows = [(5, base, 1), (5, base, 1), (5, other, 2), (6, other, 2), (None, base, 3), (7, base + " end", 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumns(
        {c: F.lit(c) for c in ("_kept", "_key", "row", "id", "key", "n", "text_key", "a`b.c")})
    kept = simhash.keep_first(odd)
    near = {r.doc_id: r.component_id for r in simhash.groups(odd.filter("doc_id = 7 or fp = 1")).collect()}
    want = [(5, base), (5, other)] + ([(7, base + " end")] if near[7] == 7 else [])
    assert kept.columns == odd.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(want)


def test_near_duplicates_of_nothing(empty):
    assert simhash.groups(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_imatch_against_brute_force(docs, texts):
    got = imatch.fingerprints(docs, low=0.05, high=0.9, buckets=4).collect()
    assert len(got) == len(texts)
    text_of = {i: t for i, t in texts}
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    following = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    slots = lambda f: [f[i:i + 8] for i in range(0, len(f), 8)]
    prints = {r.doc_id: r.fingerprint for r in got}
    after = {a[0]: b[0] for a, b in zip(order, order[1:] + order[:1])}

    def alike(f, g):
        either = [(x, y) for x, y in zip(slots(f), slots(g)) if x != "0" * 8 or y != "0" * 8]
        return sum(x == y for x, y in either) / len(either)

    seen = {}
    for r in got:
        t = text_of[r.doc_id]
        half, follow = len(t) // 2, following[r.doc_id] if r.doc_id != 8 else None
        assert r.n_chars == len(t)
        if follow is not None:
            edited = t[:len(t) - half] + follow[:half]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert abs(r.near_next - alike(r.fingerprint, prints[after[r.doc_id]])) < 1e-12
        assert abs(r.near_edited - alike(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(seen.values())) > 10
    assert {r.doc_id for r in got if r.near_edited == 1.0} >= {2, 3}  # nothing to edit


def test_imatch_buckets_do_not_matter(docs, empty):
    rows = lambda n: sorted(map(str, imatch.fingerprints(docs, buckets=n).collect()))
    assert rows(1) == rows(7)
    assert imatch.fingerprints(empty).count() == 0


def test_lexicon_is_the_band(spark):
    df = spark.createDataFrame([(i, "all " + ("some " if i < 4 else "") + f"w{i}") for i in range(10)], "doc_id long, text string")
    got = {r.h for r in imatch.lexicon(df, low=0.2, high=0.5).collect()}
    assert got == {r.h for r in spark.createDataFrame([("some",)], "w string").select(F.xxhash64("w").alias("h")).collect()}


def test_licence_phrases_and_notices(docs, texts, spark, empty):
    got = license.scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", dict(texts)[r.doc_id].translate(LOW))
        starts = [(i, label) for phrase, label in license.PHRASES for i in range(len(w))
                  if w[i:i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(w), len(starts))
        assert (r.first_word, r.last_word) == (min(s for s, _ in starts), max(s for s, _ in starts)) if starts else r.first_word is None
        assert r.base_labels == ",".join(sorted({x for _, x in starts}))
    assert license.scan(empty).count() == 0
    grant = license.NOTICES[2][0]
    words = grant.split()
    edited = " ".join(words[:12] + ["really"] + words[12:20] + words[21:])
    rows = [(1, "foo bar " + edited), (2, grant + " " + grant), (3, "Licensed under CC BY-NC 4.0."), (4, "permission is hereby"),
            (5, "All rights reserved. All rights reserved."), (6, "MIT License mit-license GNU GENERAL PUBLIC LICENSE"), (7, "licensed bsd under the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in license.scan(df).collect()}
    assert found[1].labels == "mit" and 0.75 <= found[1].score <= 1 and found[1].n_base == 0
    assert found[2].labels == "mit" and found[2].score == 1.0
    assert found[3].labels == "cc-by,cc-by-nc" and found[3].base_labels == "cc-by"
    assert found[4].labels == "" and found[7].labels == "" and found[5].labels == "all-rights-reserved"
    assert found[6].base_labels == "gpl,mit" and (found[6].n_base, found[6].first_word, found[6].last_word) == (3, 0, 4)


def test_secrets_are_found_and_masked(spark, docs, empty):
    r = np.random.default_rng(1)
    code = lambda n, of="0123456789abcdef": "".join(r.choice(list(of), n))
    rows, planted = [], {}
    for i in range(60):
        text = prose(i, 150) + " thereingonouthestre " + code(20, "0123456789") + " " + prose(i + 100, 40)
        if i % 3 == 0:
            planted[i] = [code(40), code(18), "AKIA" + code(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")][i // 3 % 3]
            text += [' token = "%s" x', " password=%s y", " %s"][i // 3 % 3] % planted[i]
        rows.append((i, text, "src"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(x.doc_id, x.value) for x in secrets.scan(df).collect()}
    assert got == set(planted.items())
    for x in secrets.redact(df).collect():
        assert x.text == rows[x.doc_id][1].replace(planted.get(x.doc_id, "\0"), "[SECRET]")
    assert secrets.scan(empty).count() == 0
    kept = secrets.redact(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert [x.text for x in kept.filter("doc_id = 12").collect()][0].count("[SECRET]") == 1
    odd = ["_id", "_key", "_secrets", "secrets", "row", "id", "body", "a`b.c"]
    named = secrets.redact(df.withColumns({c: F.lit(c) for c in odd}))
    assert named.columns == [*df.columns, *odd] and all([r[c] for c in odd] == odd for r in named.collect())


def test_a_secret_twice_in_a_document_is_one_row(spark):
    value = "0f3b" * 8
    rows = [(i, f"{prose(i, 60)} token = \"{value}\" {prose(i + 1, 9)} secret = \"{value}\" {prose(i + 2, 9)}", "s")
            for i in range(3)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len({(r.doc_id, r.key, r.value) for r in got}) == 3


def test_raking_meets_all_marginals(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), " ".join(["w"] * int(n)), f"l{r.integers(3)}", f"s{min(int(r.integers(9)), 4)}") for i, n in enumerate(r.integers(1, 60, 900))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shares = {"lang": {"l0": 0.6, "l1": 0.3, "l2": 0.1}}
    got = mixing.probabilities(df, rate=0.4, power=0.5, shares=shares, within=1e-6).toPandas()
    total = got.tokens.sum()
    assert abs((got.tokens * got.probability).sum() / total - 0.4) < 1e-6
    wanted = (got.tokens * got.weight).groupby(got.lang).sum() / total
    assert np.allclose(wanted, [0.6, 0.3, 0.1], atol=1e-4)
    for dim in ("source", "topic"):
        have = got.groupby(dim).tokens.sum() ** 0.5
        assert np.allclose((got.tokens * got.weight).groupby(got[dim]).sum() / total, have / have.sum(), atol=1e-4)
    # the same by hand
    cells = got.groupby(["source", "lang", "topic"]).tokens.sum().astype(float)
    w = cells.copy()
    for _ in range(200):
        for dim in mixing.DIMS:
            m = w.groupby(dim).sum()
            t = cells.groupby(dim).sum() ** 0.5
            t = (m * 0 + [0.6, 0.3, 0.1] if dim == "lang" else t / t.sum()) * total
            w = w * (t / m).reindex(w.index.get_level_values(dim)).to_numpy()
    one = got.groupby(["source", "lang", "topic"]).weight.first()
    assert np.allclose(one, w / cells, rtol=1e-3)
    drawn = got[got.sampled]
    assert abs(drawn.tokens.sum() / total - 0.4) < 0.05
    assert sorted(x.doc_id for x in mixing.sample(df, rate=0.4, power=0.5, shares=shares, within=1e-6).collect()) == sorted(drawn.doc_id)


def test_mixing_of_odd_rows(docs, empty):
    got = mixing.probabilities(docs, rate=1.0, power=1.0).collect()
    assert len(got) == docs.count()
    assert all(r.sampled == (r.tokens > 0) for r in got)
    kept = mixing.sample(docs, rate=0.5)
    assert kept.columns == docs.columns
    assert mixing.probabilities(empty).count() == 0 and mixing.sample(empty).count() == 0


def inner_lines(n, size):
    """(rows, rows of copies): ``n`` texts that hold one three-line menu, in a host of ``size``."""
    menu = "\n".join(prose(90 + k, 30) for k in range(3))
    rows = [(i, "h", f"{prose(i, 12)}\n{menu}\n{prose(i + 500, 8)}") for i in range(n)]
    rows += [(5000 + i, "h", prose(7, 60) + "\n" + menu) for i in range(40)]  # one text
    return rows + [(10_000 + i, "h", "x") for i in range(size - len(rows))]


@pytest.mark.parametrize("size", [100, 12_000])
def test_inner_menu_lines_count_in_a_host_of_any_size(spark, size):
    df = spark.createDataFrame(inner_lines(12, size), "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality.judge(df).filter("doc_id < 10000").collect()}
    assert all(got[i].n_shared_words == 90 and not got[i].kept for i in range(12))
    assert got[5000].n_shared_words == 90


def test_copies_of_one_text_count_once(spark):
    df = spark.createDataFrame(inner_lines(9, 60), "doc_id long, source string, text string")
    assert all(r.n_shared_words == 0 for r in quality.judge(df).collect())


def test_shared_lines_leave_the_kept_texts(spark):
    bar = "Menu  Home 1 About"
    texts = {i: f"{prose(i, 60)}\n\n {bar}\r\n{prose(i + 50, 9)}\n{bar.replace('1', str(i % 9))}\nend {i} {prose(i, 3)}" for i in range(12)}
    texts[20] = prose(20, 70) + "\n\n own \n"
    df = spark.createDataFrame([(i, t, "h", len(t)) for i, t in texts.items()], "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: r for r in quality.keep_good(df).collect()}
    assert set(got) == set(texts) and quality.keep_good(df).schema == df.schema
    for i, r in got.items():
        want = "\n".join(x for x in texts[i].split("\n") if "Menu" not in x)
        assert (r.text, r.n_chars) == (want, len(want))


def test_raking_meets_small_targets_too(spark):
    """Each source has far less than 1e-3 of the tokens; language pulls them apart."""
    r = np.random.default_rng(4)
    rows = [(f"s{i}", f"l{k}", "prose", int(r.integers(1, 60) ** 2)) for i in range(3000) for k in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, t long")
    targets = {d: mixing.tempered(cells, d, 0.7, {"l0": 0.8, "l1": 0.2} if d == "lang" else None) for d in mixing.DIMS}
    done = mixing.rake(cells, targets).toPandas()
    for dim, target in targets.items():
        want = target.toPandas().set_index(dim).target
        assert ((done.groupby(dim).w.sum().reindex(want.index) - want).abs() <= 1e-3 * want).all(), dim


def test_raking_tells_what_it_could_not_meet(spark):
    rows = [("a", "x", "prose", 10), ("b", "y", "prose", 10)]  # a diagonal: sources are languages
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, t long")
    targets = {"source": mixing.tempered(cells, "source", 1.0), "lang": mixing.tempered(cells, "lang", 1.0, {"x": 0.9, "y": 0.1})}
    with pytest.warns(mixing.RakingWarning, match="source"):
        mixing.rake(cells, targets, rounds=2)
