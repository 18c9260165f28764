"""Operators against brute force, the public library, exact round trips and held-out accuracy; nulls, empty and odd inputs."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from trigpoint.llm import bpe, common, decontam, htmltext, jaccard, langid, lm, queries, rollups, rules, toxicity, urlfilter
from trigpoint.llm.lattice import Lattice, log_table

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\v\f\r"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in enumerate(texts)], DOC)


ODD = [None, "", " \n\t", "one", "a b c d", "a b c d", "A B C D", "a b c d e", "日本語 テスト é", "x" * 5000, "same words here in this very text " * 200, "same words here in this very text " * 200, "🙂 ퟿ " + "  "]


def words(text):
    out, held = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            out += [held] if held else []
            held = ""
        else:
            held += c.lower() if "A" <= c <= "Z" else c
    return out


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                common.union(parent, i, j)
    return [(i, len(s), common.find(parent, i)) for i, s in enumerate(sets)]


def near_copies(n=60, seed=3):
    r = random.Random(seed)
    make = lambda k: [r.choice("abcdefghij") + str(r.randint(0, 400)) for _ in range(k)]
    out, passage = list(ODD), make(40)
    for _ in range(8):
        base = make(r.choice((6, 30, 200)))
        for _ in range(n // 8):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 9))
            out.append(" ".join(w))
    out += [" ".join(make(k) + passage + make(k)) for k in (0, 2, 4, 8, 60) for _ in range(3)]
    return out


def test_jaccard_is_brute_force(spark, monkeypatch):
    texts = near_copies()
    monkeypatch.setattr(jaccard, "TILE", 400)  # large groups are cut into tiles
    got = sorted(map(tuple, jaccard.jaccard_join(docs_of(spark, texts)).collect()))
    assert got == brute_components(texts)


def test_jaccard_keep_one(spark):
    texts = near_copies(24)
    docs = docs_of(spark, texts)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, c in brute_components(texts) if c == i]
    more = docs.union(docs).union(spark.createDataFrame([(None, "no id at all", None, None, None, None)], DOC))
    assert jaccard.keep_one(more).count() == kept.count() + 1
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0


def test_stars_lose_no_link(monkeypatch):
    """Whatever the number of kinds that are told apart, linked sets are connected."""
    r = np.random.default_rng(4)
    base = np.unique(r.integers(0, 1 << 62, 80).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[r.random(len(base)) > p], r.integers(0, 1 << 62, int(p * 90)).astype(np.uint64)])) for p in np.linspace(0, 0.5, 60)]
    h, cls, n, pos = [], [], [], []
    for i, s in enumerate(sets):
        k = jaccard.prefix_length(len(s), 75, 100)
        h.append(s[:k])
        cls.append(np.full(k, i))
        n.append(np.full(k, len(s)))
        pos.append(np.arange(k))
    columns = [np.concatenate(x) for x in (h, cls, n, pos)]
    for kinds in (2048, 1):
        monkeypatch.setattr(jaccard, "KINDS", kinds)
        parent = list(range(len(sets)))
        for a, b in zip(*(x.tolist() for x in jaccard._stars(*columns, 75, 100)), strict=True):
            common.union(parent, a, b)
        found = jaccard.linked(sets, 75, 100)
        assert len(set(found)) < len(sets) and all(common.find(parent, i) == common.find(parent, k) for i, k in enumerate(found))


@pytest.mark.parametrize("hot", [jaccard.HOT_SLOTS, 0])
def test_jaccard_large_group_of_near_copies(spark, monkeypatch, hot):
    """One text with copies at all distances, some linked only through others, some with none; a second family beside it."""
    r = random.Random(5)
    base, other = ([f"{c}{r.randint(0, 5000)}" for _ in range(60)] for c in "xy")
    texts = [" ".join(base), " ".join(other), None, " ".join(base)]
    for k in range(90):
        w = list(base if k % 3 else base[:30] + other[30:])
        for _ in range(r.randint(0, 6)):
            w[r.randrange(60)] = f"new{r.randint(0, 99)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard, "TILE", 500)
    monkeypatch.setattr(jaccard, "HOT_SLOTS", hot)  # no room for levels changes what is compared, and no result
    got = sorted(map(tuple, jaccard.jaccard_join(docs_of(spark, texts)).collect()))
    assert got == brute_components(texts)


def test_jaccard_rows_without_id(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, "p q r s t"), (4, "p q r s t u v w"), (4, "other words stand here now"), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ROW_KEY", F.lit("kept"))
    got = sorted(map(tuple, jaccard.jaccard_join(docs).collect()), key=repr)
    assert got == sorted([(None, 2, 1), (3, 2, 1), (1, 2, 1), (None, 1, None), (4, 4, 4), (4, 1, 4), (5, 0, 5), (5, 0, 5), (6, 0, 6)], key=repr)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "a b c d e f"), (None, "p q r s t"), (4, "p q r s t u v w"), (4, "other words stand here now"), (5, ""), (6, None)], key=repr)


def test_bits_of_keys(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    rows = spark.range(5000).select(F.when(F.col("id") % 100 < 99, F.col("id")).alias("x"))
    got = common.maybe_in(rows, F.col("x"), common.bits_of(keys, "k"), "hit").collect()
    assert len(got) == 5000
    assert all(r.hit for r in got if r.x is not None and r.x % 7 == 0)
    assert sum(r.hit for r in got if r.x is None or r.x % 7) < 20
    assert not any(r.hit for r in common.maybe_in(rows, F.col("x"), common.bits_of(keys.limit(0), "k"), "hit").collect())


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    long = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), F.lit(2_000_000)).alias("t"))
    got = [r.n for r in common.map_arrow(long, sizes, "n long").collect()]
    assert sum(got) == 60 and max(got) <= 20
    assert max(r.n for r in common.map_arrow(spark.range(0, 9000, 1, 1), sizes, "n long").collect()) == common.BATCH_ROWS


def test_linked_blocks():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 1 << 62, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[r.random(len(base)) > p], r.integers(0, 1 << 62, int(p * 300)).astype(np.uint64)])) for p in np.linspace(0, 0.4, 40)]
    want = list(range(40))
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                common.union(want, i, j)
    assert jaccard.linked(sets, 75, 100) == [common.find(want, i) for i in range(40)]
    # across two sides alone, with some sets united beforehand
    side, part = [i % 2 for i in range(40)], [i if i % 5 else 0 for i in range(40)]
    want = list(range(40))
    for i in range(40):
        common.union(want, i, part[i])
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if side[i] != side[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                common.union(want, i, j)
    assert jaccard.linked(sets, 75, 100, part, side) == [common.find(want, i) for i in range(40)]


def ranks(name="byte_bpe_multi_50k.tiktoken"):
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}


def test_bpe_is_the_public_library(spark):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    r = random.Random(2)
    texts = [*ODD, "a" * 3000, "ab" * 700, "ü" * 900, "  \n\n  x", "don't I'LL we've", "".join(chr(r.choice((97, 98, 233, 0x4E00, 0x1F600, 32, 10, 48, 33))) for _ in range(2000)), "<|endoftext|>"]
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = docs_of(spark, texts)
    got = {x.doc_id: x for x in bpe.digests(docs, path, public_tokenizers.PATTERN).collect()}
    full = bpe.encode(docs, path, public_tokenizers.PATTERN)
    rows = {x.doc_id: x for x in full.collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert rows[i].ids == ids and bytes(rows[i].decoded) == (t or "").encode()
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert {x.doc_id: x.text for x in bpe.decode(full, path).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.digests(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_decode_of_odd_ids(spark):
    rows = spark.createDataFrame([(1, [9_999_999, None]), (2, None), (3, []), (None, [72])], "doc_id long, ids array<int>")
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r.text for r in bpe.decode(rows, path).collect()}
    assert got[1] == "\ufffd\ufffd" and got[2] is None and got[3] == "" and len(got[None]) >= 1
    assert bpe.decode(rows.limit(0), path).count() == bpe.digests(docs_of(spark, ODD).limit(0), path, queries.pattern()).count() == 0


def test_rules_on_empty_tables_and_clashing_names(spark):
    docs = docs_of(spark, ["a b " * 30, None, "word " * 5]).withColumn("measured", F.lit(1)).withColumn("FAILED", F.lit(2))
    assert rules.ledger(docs.limit(0)).count() == rules.keep_good(docs.limit(0), "web-1").count() == 0
    kept = rules.keep_good(docs.union(docs), "base-1")
    assert kept.columns == docs.columns and kept.count() == 0
    assert [r.n_rows for r in rules.ablations(rules.ledger(docs), "base-1").collect()] == [3, 3]


def test_lattice_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b"abc", b"bc", b"aa", b" a"})
    lattice = Lattice(pieces)
    logp = log_table(np.arange(1.0, len(pieces) + 1), 0)
    p = dict(zip(pieces, np.exp(logp[:-1]), strict=True))

    def total(w):
        return 1.0 if not w else sum(p[w[:k]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in p)

    def counts(w, prob, out):
        if not w:
            return prob
        s = 0
        for k in range(1, len(w) + 1):
            if w[:k] in p:
                x = counts(w[k:], prob * p[w[:k]], out)
                out[w[:k]] += x
                s += x
        return s

    some = [b" abcabc", b"a", b"aaaa", b"zab", b"\xff\x00b", b"abcab" * 2]
    assert np.allclose(lattice.scores(some, logp[:, None])[:, 0], [math.log(total(w)) for w in some])
    want = Counter()
    weights = np.arange(1.0, len(some) + 1)
    for w, k in zip(some, weights, strict=True):
        own = Counter()
        s = counts(w, 1.0, own)
        for piece, c in own.items():
            want[piece] += k * c / s
    assert np.allclose(lattice.expected(some, weights, logp), [want[x] for x in pieces])


def test_language_held_out(spark):
    got = queries.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), F.lit(True))
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs_of(spark, [*ODD, "1234 !?"]), model).collect()}
    assert all(odd[i] == ("und", 0.0) for i in (0, 1, 2, len(ODD))) and all(0 <= s <= 1 for _, s in odd.values())
    assert {r.doc_id for r in langid.keep_known(docs_of(spark, ODD), model).collect()} <= {i for i, (lang, _) in odd.items() if lang != "und" and i < len(ODD)}
    none = langid.learn(docs.limit(0), queries.vocabulary("byte_bpe_multi_50k.tiktoken"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs_of(spark, ["abc"]), none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == langid.keep_known(docs.limit(0), model).count() == langid.keep_known(docs, none).count() == 0


def brute_language(word, table):
    """Probability of a word over all segmentations, by recursion over its beginnings."""
    p = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        p[j] = sum(p[i] * table.get(word[i:j], 0.0) for i in range(j))
    return p[-1]


def test_language_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), F.lit(True))
    again = langid.learn(docs.orderBy(F.desc("doc_id")).union(docs.limit(3)), queries.vocabulary("byte_bpe_multi_50k.tiktoken"), F.lit(True))
    assert np.allclose(model.logp, again.logp)
    tables = [dict(zip(model.pieces, np.exp(model.logp[:-1, k]).tolist(), strict=True)) for k in range(len(model.languages))]
    size = sum(map(len, model.pieces))
    none = {p: len(p) / size for p in model.pieces}
    texts = ["the of and", "der die das nicht", "los que de la", "Q", "qxzj wvkq zzxq jjjq", "Привет мир как дела", "le une des", "zxqj"]
    got = {r.doc_id: r for r in langid.predict(docs_of(spark, texts), model).collect()}
    kept = {r.doc_id for r in langid.keep_known(docs_of(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        own = [[math.log(brute_language(b" " + w.encode(), table)) for w in langid.letter_words(t)] for table in (*tables, none)]
        own = [sum(x) for x in own]
        best = max(own[:-1])
        assert got[i].lang_pred == model.languages[own.index(best)]
        assert math.isclose(got[i].score, 1 / sum(math.exp(x - best) for x in own[:-1]), rel_tol=1e-6)
        assert (i in kept) == (best >= own[-1])
    assert kept != set(range(len(texts))) and {0, 1, 2, 6} <= kept  # letters alone don't make a language
    assert {r.doc_id for r in langid.keep_known(docs_of(spark, texts), model, ("de",)).collect()} == {i for i in kept if got[i].lang_pred == "de"}


def test_all_languages_are_learned(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" * 3, f"l{i:03}") for i in range(203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), F.lit(True))
    assert model.languages == [lang for _, _, lang in rows]
    assert {(r.doc_id, r.lang_pred) for r in langid.predict(docs.where("doc_id >= 195"), model).collect()} == {(i, lang) for i, _, lang in rows[195:]}
    blocks = langid.Scorer(model).totals([t for _, t, _ in rows[:20]])[0]
    monkeypatch.setattr(langid, "BLOCK", 1000)
    assert np.array_equal(blocks, langid.Scorer(model).totals([t for _, t, _ in rows[:20]])[0])


def test_rules(spark):
    texts = [*ODD, "w1 w2 w3 w4 w5 w6 w7 w8 " * 2 + " ".join(f"wording{i}" for i in range(60)), "line one\nline one\n\nline two\n" + " ".join(f"wording{i}" for i in range(40)), " ".join(f"word{i}###" for i in range(40))]
    rows = {r.doc_id: r for r in rules.apply_policy(rules.ledger(docs_of(spark, texts)), "web-1").collect()}

    def repeated(t):
        w = [x for x in "".join(" " if c in SPACES else c for c in t or "").split(" ") if x]
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = Counter(win)
        return len({i + j for i, x in enumerate(win) if seen[x] > 1 for j in range(8)})

    for i, t in enumerate(texts):
        assert rows[i].n_words == len(words(t)) and rows[i].n_repeat_words == repeated(t) and rows[i].word_chars == sum(map(len, words(t)))
    assert rows[len(ODD) + 1].n_dup_lines == 1 and not rows[len(ODD) + 2].kept and rows[len(ODD) + 1].kept
    ledger = rules.ledger(docs_of(spark, texts))
    lost = {r.rule: r for r in rules.ablations(ledger, "web-1").collect()}
    assert lost["symbols"].n_only == 1 and lost["few_words"].n_rows == len(texts)
    clash = docs_of(spark, texts).withColumnRenamed("score", "measured").withColumn("n_words", F.lit(0))
    good = rules.keep_good(clash, "web-1")
    assert good.columns == clash.columns and {r.doc_id for r in good.collect()} == {i for i, r in rows.items() if r.kept}


def test_lm_base_is_brute_force(spark):
    texts = [*ODD, *[f"the cat w{i % 7} sat on w{i % 11} mat" for i in range(80)]]
    docs = docs_of(spark, texts).withColumn("held", F.col("doc_id") % 7 == 2)
    got = {r.doc_id: r for r in lm.lm_scores(docs, queries.vocabulary("piece_bpe_32k.model"), F.col("held")).collect()}
    own = {i: [*words(t), None] for i, t in enumerate(texts)}
    c = Counter(w for i, t in own.items() if i % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in own.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 7 == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9) and r.score < 0
    twice = lm.lm_scores(docs.union(docs), queries.vocabulary("piece_bpe_32k.model"), F.col("held")).groupBy("doc_id").agg(F.countDistinct("n_tokens").alias("k"), F.count("*").alias("n")).collect()
    assert {(r.k, r.n) for r in twice} == {(1, 2)}
    assert lm.lm_scores(docs.limit(0), queries.vocabulary("piece_bpe_32k.model"), F.col("held")).count() == 0
    alone = lm.lm_scores(docs, queries.vocabulary("piece_bpe_32k.model"), F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known) for r in alone} == {(0, 0)} and all(math.isfinite(r.score) for r in alone)


def test_lm_score_is_brute_force(spark, monkeypatch):
    made, start = [], lm.Weights.__init__
    monkeypatch.setattr(lm.Weights, "__init__", lambda self, *a: made.append(self) or start(self, *a))
    texts = ["the cat sat", "the the mat", None, "unheard of words", "x", "cat mat é", *[f"the cat w{i % 3}" for i in range(20)]]
    path = queries.vocabulary("piece_bpe_32k.model")
    got = {r.doc_id: r.score for r in lm.lm_scores(docs_of(spark, texts), path, F.col("doc_id").isin(3, 5)).collect()}
    w, pieces = made[0], lm.sentencepiece_pieces(path, lm.LONGEST)
    table = dict(zip(pieces, np.exp(w.logp[:-1]).tolist(), strict=True))
    c = Counter(x for i, t in enumerate(texts) if i not in (3, 5) for x in [*words(t), None])
    n = sum(c.values())
    whole = min(0.99, max(0.05, 1 - sum(k == 1 for x, k in c.items() if x is not None) / n))
    for i, t in enumerate(texts):
        want = math.log10((1 - whole) * math.exp(w.log_end) + whole * c[None] / n)
        want += sum(math.log10((1 - whole) * brute_language(b" " + x.encode(), table) + whole * c[x] / n) for x in words(t))
        assert math.isclose(got[i], want, rel_tol=1e-6), (i, got[i], want)


def test_lm_weights_rest_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE", 5)
    texts = [f"qqzz{i} zzqq{i}" for i in range(40)] + [f"walking talker{i} homeward{i % 9}" for i in range(80)]

    def scores(own):
        return {r.doc_id: r.score for r in lm.lm_scores(spark.createDataFrame(own, "doc_id long, text string"), queries.vocabulary("piece_bpe_32k.model"), F.col("doc_id") % 7 == 2).collect()}

    rows = list(enumerate(texts))
    one, other = scores(rows), scores(rows[::-1])
    assert len(one) == len(texts) and all(math.isclose(one[i], other[i], rel_tol=1e-9) for i in one)


PAGES = [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"),
    ("<nav>menu</nav><article><h1>T &amp; U</h1><p>One  two<br>three<p><b>x</b>y</p></article><footer>f</footer>", "T & U\n\nOne two three\n\nxy"),
    ("<body><div class='ad'>buy</div><main><p>Text, here.</p><aside>side</aside><div class=comments><p>me too</p></div><script>var t='</p>';</script><form>q</form></main>", "Text, here."),
    ("<body><header>site</header><div id=content><p>Long enough sentence, it is.</p><p>And more of it.</p></div><div class=sidebar><p>other</p></div></body>", "Long enough sentence, it is.\n\nAnd more of it."),
    ("<article><p>cut off <a href='x", "cut off"), ("<article><!-- no --><p>&lt;b&gt; &#233;&nbsp;&eacute;</p></article>", "<b> é é"),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(pages).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i] == (want, len(want)), (i, got[i])
    assert htmltext.main_text("<div>" * 20_000 + "deep") in ("deep",)


@pytest.mark.parametrize("n", [10, 20, 200])
def test_html_long_pages_without_article(n):
    paragraph = "A sentence of some fifty characters, as they usually go. " * 7
    before, after = [f"{i} {paragraph.strip()}" for i in range(n // 2)], [f"{i} {paragraph.strip()}" for i in range(n // 2, n)]
    tags = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    items, quote = [f"item {i} with a few words that make up sixty characters or so." for i in range(3)], "A quotation, said by someone."
    inner = f"{tags(before)}<ul>{''.join(f'<li>{t}</li>' for t in items)}</ul><blockquote>{quote}</blockquote><pre>x = 1</pre>{tags(after)}"
    links = "<ul>" + "<li><a href=x>Somewhere else on this site</a></li>" * 9 + "</ul>"
    page = f"<body>{links}<div><h1>T</h1><div>{inner}</div>{links}</div><div><div>(c) 2024</div></div></body>"
    got = htmltext.main_text(page).split("\n\n")
    assert got[: n + 6] == ["T", *before, *items, quote, "x = 1", *after] and "Somewhere else on this site" not in got


def test_html_lists_of_links():
    links = "<ul>" + "<li><a href=x>Somewhere else on this site</a></li>" * 9 + "</ul>"
    page = f"<main><h1><a href=x>T</a></h1>{links}<p>Text, <a href=y>a link</a> and more of it.</p><p><a href=z>Only a link</a></p></main>"
    assert htmltext.main_text(page) == "T\n\nText, a link and more of it.\n\nOnly a link"
    text = "<p>" + "A sentence of the article, with a comma in it. " * 5 + "</p>"
    for page in (f"<div>{text}<ul><li><a href=x>A link item of the article</a></ul>{text}</div>", f"<article>{text}{links}{text}</article>"):
        assert len(htmltext.main_text(page).split("\n\n")) == 2 + page.count("<li>")  # between content links stay


def test_html_teasers_and_sidebars():
    text = "<p>" + "A sentence of the article, with a comma in it. " * 5 + "</p>"
    page = f"<body><article>{text * 3}</article><article><h2>Another</h2><p>One line, read on.</p></article></body>"
    assert htmltext.main_text(page).count("A sentence") == 15 and "Another" not in htmltext.main_text(page)
    page = f"<body><div><p>Short, to the side.</p><p>Also there.</p></div><div>{text * 4}</div></body>"  # the same path of tags
    assert htmltext.main_text(page).count("A sentence") == 20 and "side" not in htmltext.main_text(page)


def test_html_by_ratios_without_names():
    """Pages whose article is a plain div among plain divs, and an ablation without the threshold."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    blank = lambda h: h.replace("article>", "div>").replace(' class="ad"', "").replace("nav>", "div>").replace("footer>", "div>")

    def figures():
        found = [(htmltext.main_text(r["html"]).split("\n\n"), htmltext.main_text(blank(r["html"])).split("\n\n")) for r in rows]
        shared = sum(sum(map(len, [x for x in got if x in want])) for want, got in found)
        return shared / sum(len(x) for _, got in found for x in got), shared / sum(len(x) for want, _ in found for x in want), sum(a == b for a, b in found)

    precision, recall, whole = figures()
    assert precision > 0.975 and recall > 0.999 and whole > len(rows) / 2
    kept, htmltext.THRESHOLD = htmltext.THRESHOLD, 0.0
    try:
        assert figures()[2] == 0
    finally:
        htmltext.THRESHOLD = kept


CLASH = ("_key", "_first", "_bits", "_bit_row", "row_key", "row_maybe", "near_key", "near_first", "measured", "bit_row", "key", "root", "first")


def clashing(spark, rows, text="text"):
    return spark.createDataFrame([(i, t, "en", *(str(k) for k in range(len(CLASH)))) for i, t in rows], f"doc_id long, `{text}` string, lang string, " + ", ".join(f"`{c}` string" for c in CLASH))


def test_stages_on_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = clashing(spark, [(1, base), (2, base + " more"), (3, base), (4, None), (5, "other words here " * 9)])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    assert {r.near_key for r in kept.collect()} == {"6"}
    items = spark.createDataFrame([(1, base)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect()) == [4, 5]


def test_columns_by_their_names_in_any_case(spark):
    good = " ".join(f"word{i}" for i in range(40))
    docs = clashing(spark, [(1, good), (2, "few words"), (3, None)], "Text")
    assert [r.doc_id for r in rules.keep_good(docs, "web-1").collect()] == [1]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, spark.createDataFrame([(1, good)], "item_id long, text string")).collect()) == [2, 3]
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 2, 3]
    model = langid.learn(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), F.lit(True))
    assert {r.doc_id for r in langid.keep_known(docs, model).collect()} <= {1, 2}
    with pytest.raises(ValueError, match="none of the columns"):
        rules.keep_good(docs.drop("Text"), "web-1")


def test_repeated_rows_teach_the_same_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS", 30)
    rows = [(i, f"{w} {w}{i % 17} {'abcdefghij'[i % 10] * 3}", lang) for i in range(400) for lang, w in (("en", "the"), ("fr", "les"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    once = langid.learn(docs, path, F.lit(True))
    often = langid.learn(docs.crossJoin(spark.range(20)).drop("id"), path, F.lit(True))
    assert once.languages == often.languages == ["en", "fr"] and np.array_equal(once.logp, often.logp)


def test_two_vocabularies_of_one_name(spark, tmp_path):
    made = []
    for k, name in enumerate(("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")):
        (tmp_path / str(k)).mkdir()
        made.append(tmp_path / str(k) / "own.tiktoken")
        made[k].write_bytes(open(public_tokenizers.path(name), "rb").read())
    docs = docs_of(spark, ["Grüße, 日本語 and words", "more"])
    ids = [[r.ids for r in bpe.encode(docs, str(p), public_tokenizers.PATTERN).orderBy("doc_id").collect()] for p in made]
    for own, name in zip(ids, ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"), strict=True):
        known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})
        assert own == [known.encode_ordinary("Grüße, 日本語 and words"), known.encode_ordinary("more")]


def test_html_weights_are_brute_force():
    """Sums of paths, smoothing, fusing and threshold by plain loops."""
    r = random.Random(8)
    for _ in range(200):
        n = r.randint(1, 30)
        path, holder = [], []
        for i in range(n):  # blocks of a holder mostly stand together, and a path has one holder
            holder.append(holder[-1] if i and r.random() < 0.6 else r.randint(0, 4))
            path.append(holder[-1] * 3 + r.randint(0, 2))
        path = [sorted(set(path)).index(p) for p in path]
        length = [r.randint(1, 400) for _ in range(n)]
        marks, linked = [r.randint(0, x // 8) for x in length], [r.choice([0, 0, r.randint(0, x), x]) for x in length]
        chars, points, share = [], [], []
        for p in path:
            own = [i for i in range(n) if path[i] == p]
            chars.append(sum(length[i] for i in own) / len(own))
            points.append(sum(marks[i] for i in own) / len(own))
            share.append(sum(linked[i] for i in own) / sum(length[i] for i in own))

        def smooth(x):
            at = lambda i, j: x[j] if 0 <= j < n and holder[j] == holder[i] else x[i]
            return [0.25 * at(i, i - 1) + 0.5 * x[i] + 0.25 * at(i, i + 1) for i in range(n)]

        want = [c * (1 + p) * (1 - d) for c, p, d in zip(smooth(chars), smooth(points), share, strict=True)]
        weight, density = htmltext.path_weights(*(np.array(x, int) for x in (path, holder)), *(np.array(x, float) for x in (length, marks, linked)))
        assert np.allclose(weight, want) and np.allclose(density, share)
        total = sum(w * x for w, x in zip(want, length, strict=True))
        if total:
            assert math.isclose(htmltext.threshold(weight, np.array(length, float)), 0.3 * sum(w * w * x for w, x in zip(want, length, strict=True)) / total)


def test_html_weights_decide_on_pages_as_they_are(monkeypatch):
    """With other weights, other text, on pages that have an article and parts with telling names."""
    import pyarrow.parquet as pq

    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    texts = lambda: [htmltext.main_text(h) for h in pages]
    own = texts()
    changed = lambda: sum(a != b for a, b in zip(own, texts(), strict=True)) / len(pages)
    r = np.random.default_rng(3)
    with monkeypatch.context() as m:  # weights by chance instead of ratios and names
        m.setattr(htmltext, "NOISE_PRIOR", 1.0)
        m.setattr(htmltext, "ARTICLE_PRIOR", 1.0)
        m.setattr(htmltext, "path_weights", lambda path, *_: (r.random(path.max() + 1)[path], np.zeros(len(path))))
        assert changed() > 0.9
    with monkeypatch.context() as m:
        m.setattr(htmltext, "THRESHOLD", 1e9)
        assert changed() == 1
    with monkeypatch.context() as m:  # ratios without the weight of names
        m.setattr(htmltext, "NOISE_PRIOR", 1.0)
        m.setattr(htmltext, "ARTICLE_PRIOR", 1.0)
        assert 0.3 < changed() < 0.7


@pytest.mark.parametrize("copies", [1, 40])
def test_html_does_not_depend_on_length(copies):
    """However long comments, notices and teasers are, and however short the article."""
    para = "A sentence of the article, with a comma in it. And one more, to end it."
    noise = "A comment by a reader, who has much to say, and says it. " * 8
    page = f"<body><nav><a href=x>Home</a></nav><div class='cookie-notice'><p>{noise * copies}</p></div><article><h1>T</h1><p>{para}</p><div class=ad><p>{noise}</p></div><p>{para}</p></article><section id=comments>{f'<p>{noise}</p>' * copies}</section></body>"
    assert htmltext.main_text(page) == f"T\n\n{para}\n\n{para}"
    long = f"<article><h1>T</h1>{f'<p>{para * 3}</p>' * 5 * copies}</article>"
    assert htmltext.main_text(f"<body>{long}<article><h2>More</h2><p>Read on.</p></article></body>").endswith(para)


def test_html_takes_time_in_proportion():
    import time

    for piece in ("<div>x", "<ul><li>x", "<p><b>x", "<article>x", "<table><tr><td>x"):
        began = time.time()
        htmltext.main_text(piece * 20_000)
        assert time.time() - began < 5, piece


def test_html_empty_table_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a, b</p>", "x"), (1, "u", "<p>a, b</p>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(((r.page_id, r.text) for r in htmltext.extract(pages).collect()), key=repr) == [(1, "a, b"), (1, "a, b"), (None, "")]
    assert htmltext.extract(pages.limit(0)).count() == 0


DELTA = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def test_rollups_commit_once(spark, tmp_path):
    r = rollups.Rollup(spark, f"file://{tmp_path}/r")
    rows = lambda: sorted(map(tuple, r.totals().collect()), key=repr)
    assert rows() == [] and not r.compact()
    first = spark.createDataFrame([("insert", "a", "en", "1", 10, None), ("insert", "a", "en", "1", 5, None), ("insert", None, None, "1", None, None), ("odd", "a", "en", "1", 99, None)], DELTA)
    second = spark.createDataFrame([("delete", "a", "en", "1", 5, None), ("revise", "a", "en", "1", 12, 10)], DELTA)
    want = sorted([("a", "en", "1", 1, 12), (None, None, "1", 1, 0)], key=repr)
    assert r.commit("1", first) and not r.commit("1", first) and r.commit("2", second)
    (tmp_path / "r" / "batch-3").mkdir()  # a commit that broke off
    assert rows() == want
    assert r.compact() and rows() == want and not r.compact()
    assert not r.commit("1", first) and not r.commit("2", second) and rows() == want  # merged batches are remembered
    (tmp_path / "r" / "base-9").mkdir()  # a merge that broke off
    assert rows() == want and r.commit("3", first) and r.compact()
    assert rows() == sorted([("a", "en", "1", 3, 27), (None, None, "1", 2, 0)], key=repr) and not r.commit("3", first)
    r.vacuum()
    assert rows() == sorted([("a", "en", "1", 3, 27), (None, None, "1", 2, 0)], key=repr) and not r.commit("2", second)
    assert len([p for p in (tmp_path / "r").iterdir() if p.is_dir()]) == 1


def test_token_counts_are_the_public_library(spark):
    vocabularies = {v: queries.vocabulary(f"{v}.tiktoken") for v in queries.VERSIONS}
    enc = {}
    for v, path in vocabularies.items():
        with open(path, "rb") as f:
            enc[v] = tiktoken.Encoding(v, pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    docs = docs_of(spark, ODD)
    got = {r.doc_id: r for r in rollups.count_tokens(docs, vocabularies, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(ODD):
        assert {v: got[i].tokens[v] for v in vocabularies} == {v: len(e.encode_ordinary(t or "")) for v, e in enc.items()} and got[i].words == len(words(t))
    assert rollups.count_tokens(docs.limit(0), vocabularies, public_tokenizers.PATTERN).count() == 0
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if len(words(r.text)) >= 20:
            for v, e in enc.items():
                want[r.source, r.lang, v, "docs"] += 1
                want[r.source, r.lang, v, "tokens"] += len(e.encode_ordinary(r.text))
    rows = queries.op7_token_counts(spark, SF).collect()
    assert {(r.source, r.lang, r.tokenizer, k): x for r in rows for k, x in (("docs", r.n_docs), ("tokens", r.n_tokens))} == dict(want)


def test_urls(spark):
    cases = [
        (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://x.net", "x.net", "", None, "allow"), ("http://x.com/?u=http://y.net/", "x.com", "/", None, "allow"), ("http://www.big-casino.com/", "www.big-casino.com", "/", None, "block"), ("http://a.org/fr/1", "a.org", "/fr/1", "org/fr/", "allow"),
        ("https://sub.example.com/de/5", "sub.example.com", "/de/5", "example.com/de/", "block"), ("http://notexample.com/de/5", "notexample.com", "/de/5", None, "allow"), ("http://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge_urls(pages, queries.URL_RULES).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]
    array = urlfilter.DigestArray([f"host{i}.example/" for i in range(500)])
    array.keys = np.repeat(array.keys[:1], 500)  # equal digests: strings decide
    assert not array.holds(["other.example/"]).any()
    assert not urlfilter.DigestArray([]).holds(["a"]).any()


def test_digest_array_of_a_table(spark):
    entries = [f"host{i}.example/" for i in range(3000)] + ["é/", "", "host1.example/", None]
    pages = spark.createDataFrame([(i, f"http://a.host{i * 7}.example/x", "v") for i in range(600)] * 2 + [(None, None, None)], "page_id long, url string, verdict string")
    table = spark.createDataFrame([(e,) for e in entries], "host string")
    got = urlfilter.judge_urls(pages, {}, table).collect()
    assert len(got) == 1201 and all((r.verdict == "block") == (r.page_id is not None and r.page_id * 7 < 3000) for r in got)
    assert urlfilter.judge_urls(pages.limit(0), {}, table).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(pages, {}, table.limit(0)).collect()} == {"allow"}
    own = urlfilter.DigestArray(["ab", "cd"])
    own.keys = np.full_like(own.keys, own.keys[0])  # digests that collide
    first = urlfilter._digests([b"ab", b"cd"]).tolist().index(int(own.keys[0]))
    assert own.holds([("ab", "cd")[first], "zz"]).tolist() == [True, False]


def label_rows(n, seed):
    r = random.Random(seed)
    plain = lambda: " ".join(r.choice(["the", "tree", "is", "green", "and", "we", "walk", "home", "thing"]) for _ in range(30))
    return [(i, f"{plain()}. you {r.choice(['zurkish', 'blorted'])}{r.choice(['a', 'b'])} thing. {plain()}", 1) if i % 4 == 0 else (i, plain(), 0) for i in range(n)]


def test_toxicity(spark):
    rows = label_rows(240, 4)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(0, "another text of the same id", "x"), (None, "no id", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows] + [(0, 0), (None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    again = toxicity.learn(docs.repartition(7), labels.orderBy(F.desc("doc_id")), F.lit(True))
    assert model.insults == again.insults and np.allclose(model.weights, again.weights)
    g = toxicity.Grammar(model.insults)
    score = lambda t: float(model.score(g.read(t)[0][None])[0])
    assert score("you zurkishc") >= 0.7 > score("the tree is green") and score(None) == score("") < 0.5
    assert score("it is zurkisha") > score("it is not zurkisha") and score("they zurkisha") > score("said zurkisha")
    held = label_rows(120, 9)
    got = {r.doc_id: r.score >= 0.7 for r in toxicity.score(spark.createDataFrame([x[:2] for x in held], "doc_id long, text string"), model).collect()}
    assert [got[i] for i, _, _ in held] == [bool(k) for *_, k in held]
    assert toxicity.score(docs_of(spark, ODD), model).count() == len(ODD)
    assert toxicity.score(docs_of(spark, ODD).limit(0), model).count() == 0
    none = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert none.insults == {} and 0 < none.score(np.zeros((1, len(toxicity.WEIGHTS))))[0] < 1


def by_hand(symbols):
    """The grammar's rules without transducers: weights of each clause, by name."""
    out, reported, quoted, negated, since = [], False, False, 0, 0
    parts, at = [], 0
    for i, x in enumerate(symbols + "."):
        if x in ".:":
            parts.append((symbols[at:i], x))
            at = i + 1
    for part, ending in parts:
        own, negated, some = Counter(), 0, False
        for x in part:
            if x in toxicity.HARM:
                if x == "h" and "t" not in part:
                    negated = 0
                    continue
                own.update("abc"[: "abc".index(x) + 1] if x in "abc" else x)
                own["negated"] += negated > 0
                own["reported"] += reported or quoted
                own["targeted"] += "t" in part and x != "h"
                own["further"] += some
                some, negated = True, 0
            elif x == "n":
                negated = toxicity.REACH
            elif x == "q":
                quoted, reported = (False, False) if quoted else (reported, False)
            else:
                reported = reported or x == "r" and not quoted
                negated = max(0, negated - 1)
        reported = reported and ending == ":"
        if some:
            out.append({k: v for k, v in own.items() if v})
    return out


def test_grammar_is_its_rules():
    r = random.Random(8)
    names, g = list(toxicity.WEIGHTS), toxicity.Grammar({})
    for _ in range(3000):
        symbols = "".join(r.choice("abch" + "tnrq:.---") for _ in range(r.randint(0, 14)))
        got = [{names[i]: int(v) for i, v in enumerate(c) if v} for c in g.clauses(symbols)]
        assert got == by_hand(symbols), symbols


def test_composition_is_the_cascade():
    r = random.Random(2)
    steps = [toxicity.negation(), toxicity.report(), toxicity.target(), toxicity.clause()]
    whole = steps[0].then(steps[1]).then(steps[2]).then(steps[3])
    for _ in range(300):
        tapes = [(tuple(r.choice("abchtnrq:.-") for _ in range(r.randint(0, 9))), ())]
        want = whole.paths(tapes[0][0])
        for t in steps:
            tapes = [(out, names + more) for tape, names in tapes for out, more in t.paths(tape)]
        assert sorted((out, sorted(names)) for out, names in tapes) == sorted((out, sorted(names)) for out, names in want)


def test_threats_before_and_after_their_target():
    g, names = toxicity.Grammar({"zurkish": 3}), list(toxicity.WEIGHTS)
    read = lambda t: [{names[i] for i in np.flatnonzero(c)} for c in g.clauses(g.symbols(t))]
    assert read("I will kill you.") == read("you I will kill.") == [{"h"}]
    assert read("kill the process") == [] == read("kill it. you")
    assert read("never kill you") == [{"h", "negated"}]
    assert read("he said: I will kill you") == [{"h", "reported"}] and read("you zurkish") == [{"a", "b", "c", "targeted"}]


def test_decontamination_is_brute_force(spark):
    r = random.Random(5)
    make = lambda k: [f"w{r.randint(0, 300)}" for _ in range(k)]
    items = [make(k) for k in (5, 9, 20, 40, 60, 3, 1)]
    texts = [*ODD, *[" ".join(make(500) + i[: r.randint(len(i) // 2, len(i))] + make(500)) for i in items for _ in range(6)]]
    bench = spark.createDataFrame([(i, " ".join(w), 0) for i, w in enumerate(items)] + [(98, None, 0), (99, "  ", 0)], "item_id long, text string, doc_id long")
    got = {(x.doc_id, x.item_id, x.n_shingles, x.n_shared) for x in decontam.contained_items(docs_of(spark, texts), bench).collect()}
    want = set()
    for d, t in enumerate(map(words, texts)):
        for i, w in enumerate(items):
            k = min(5, len(w))
            own = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
            have = {tuple(t[a : a + k]) for a in range(max(0, len(t) - k + 1))}
            if 100 * len(own & have) >= 75 * len(own):
                want.add((d, i, len(own), len(own & have)))
    assert got == want and len({i for _, i, *_ in want}) >= 5
    clean = decontam.drop_contaminated(docs_of(spark, texts), bench)
    assert {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {d for d, *_ in want}
    assert decontam.contained_items(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(40)] + [(r.randint(100, 300), r.randint(100, 300)) for _ in range(90)] + [(500, k) for k in range(501, 560)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = list(range(600))
    for a, b in pairs:
        common.union(parent, a, b)
    assert got == {x: common.find(parent, x) for p in pairs if p[0] != p[1] for x in p}


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in rules.apply_policy(rules.ledger(spark.read.parquet(f"{SF}/documents.parquet")), "web-1").where("kept").collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(table, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), ~(queries.remainder(4) == 2))
    known = {r.doc_id for r in langid.keep_known(table, model).collect()}
    own = sorted(i for i in docs if i in good and i in known)
    first = {own[c] for _, _, c in brute_components([docs[i] for i in own])}
    bench = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i in first if not any(100 * len(b & shingles(docs[i])) >= 75 * len(b) for b in bench)}
    assert {r.doc_id for r in rows} == want
    assert all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in rows)


def test_pipeline_stages_on_odd_rows_and_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    good = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    odd = [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, None, None, None, None), (1003, "one", None, None, None)]
    odd = spark.createDataFrame(odd, good.schema)
    for k, rows in enumerate((good.union(odd), good.limit(0))):
        folder = tmp_path / str(k)
        rows.withColumn("ROW_KEY", F.lit("x")).withColumn("measured", F.lit(1)).write.parquet(f"file://{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"file://{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"file://{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, common.staged(stage(spark, docs, f"file://{folder}"), name)
            assert docs.columns == before.columns or name == "byte_bpe"
        assert (docs.count() > 0) == (k == 0)
