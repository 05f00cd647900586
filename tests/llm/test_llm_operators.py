"""Brute-force checks of the operators on sf0.001, and defined results for odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import regex
import pytest

from spate.llm import decontaminate, lm_score, mixing, ngram_join, pii, quality_gam, quality_rules, token_counts, toxicity, warc
from spate.llm.common import stage_path
from spate.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CARD = "4111 1111 1111 1111"
LONG = "lorem ipsum dolor " * 4000
ODD = [
    (1, None, None, None, 7),
    (2, "", "en", "src1", 7),
    (3, "one", "en", "src1", 7),
    (4, "a b c d e f g h i j k l", "en", None, 7),
    (5, "A B C D E f g h i j k l", None, "src2", 7),
    (6, f"mail bob@mail.example.org or {CARD} at 10.0.0.1 or +46 70 123 45 67 é\U0001F600 x@y.z", "de", "src0", 7),
    (7, LONG, "en", "src0", 7),
    (7, LONG, "en", "src0", 7),
    (None, "no id here", "en", "src9", 7),
    (8, "#### %%% \n \n\t", "", "", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, score int"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    cols = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_decontaminate_odd(spark, odd, none):
    bench = spark.createDataFrame([("x", "a b c d e f g h i j"), ("y", "one"), ("z", None), ("y", "one")], "item_id string, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.decontaminate(odd, bench).collect()}
    assert got[(4, 12)]["n_hit"] == 10 and got[(5, 12)]["n_hit"] == 10 and got[(3, 1)]["contaminated"]
    assert got[(1, 0)]["n_hit"] == 0 and got[(None, 3)]["n_items"] == 0
    assert got[(4, 12)]["hit_spans"] == "0:19"
    assert got[(4, 12)]["items_sha256"] == hashlib.sha256(b"x").hexdigest()
    many = {(r["doc_id"], r["n_words"]): r for r in decontaminate.decontaminate(odd, bench, max_bytes=64).collect()}
    assert many == got  # several automata give what one gives
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0
    kept = decontaminate.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3


def test_toxicity(spark, odd, none):
    text = lambda i, bad: " ".join(f"w{(i * 7 + k * 13) % 97}" for k in range(30)) + (f" vile{i % 5} w{i}" if bad else "")
    docs = spark.createDataFrame([(i, text(i, i % 4 == 0)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], LABELS)
    model = toxicity.fit(docs, labels)
    got = rows(toxicity.score(docs, model))
    wrong = [i for i in range(300, 400) if got[i]["predicted"] != int(i % 4 == 0)]
    assert len(wrong) <= 5, wrong
    a, b = map(int, got[304]["spans"].split(",")[0].split(":"))
    assert text(304, True)[a:b].startswith("vile")
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(none, model).count() == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    flat = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, flat).collect()} == {flat.score([[0, 0]] @ __import__("numpy").zeros((2, 2)))[0]}


def test_chain_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    x, first = rng.normal(size=(9, 2)), np.array([1, 0, 0, 0, 1, 1, 0, 0, 0], bool)
    c = toxicity.Chain(rng.normal(size=2), rng.normal(size=(2, 2)), rng.normal(size=2))
    got = c.marginals(x, first)
    starts = [*np.flatnonzero(first), 9]
    for a, b in zip(starts, starts[1:]):
        weight, hot = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            s = c.start[y[0]] + sum(c.trans[p, q] for p, q in zip(y, y[1:])) + sum((x[a + k] @ c.emit) * v for k, v in enumerate(y))
            weight += math.exp(s)
            hot += math.exp(s) * np.array(y)
        assert np.allclose(got[a:b], hot / weight)


def jaccard_components(texts):
    sets = {}
    for i, t in texts.items():
        w = fold(t).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 4 * n >= 3 * (len(sets[a]) + len(sets[b]) - n):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_equals_all_pairs(spark, texts):
    more = dict(texts)
    base = " ".join(f"t{k}" for k in range(60))
    for k in range(40):  # a chain of near copies, and a passage that many texts share
        more[10_000 + k] = base.replace(f"t{k} ", f"u{k} ").replace("t30", "t30" if k % 2 else "v30")
        more[20_000 + k] = base + " " + " ".join(f"x{k}y{j}" for j in range(k))
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect()}
    assert got == jaccard_components(more)


@pytest.mark.parametrize("block", [512, 16])
def test_ngram_join_counts_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    words = [f"t{k}" for k in range(100)]
    docs = {k: " ".join([*words[:k], f"u{k}", *words[k + 1 :]]) for k in range(60)}
    docs |= {100 + k: docs[k] for k in range(5)} | {200: "a b c d e f", 201: "a b c d e f g", 300: "x y z"}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(len(t.split()) - 4, 1))} for i, t in docs.items()}
    each = {frozenset(s) for s in sets.values()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_join(df).collect()}
    assert got == {i: sum(4 * len(s & o) >= 3 * len(s | o) for o in each if o != s) for i, s in sets.items()}
    assert got[0] == got[100] >= 50


def test_ngram_join_odd_rows(spark, odd, none):
    got = ngram_join.ngram_join(odd).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(1, 3)]
    assert by[4] == [(8, 4)] and by[5] == [(8, 4)] and len(by[7]) == 2 and by[None] == [(1, None)]
    assert ngram_join.ngram_join(none).count() == 0
    kept = ngram_join.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "8", "None"]


def brute_pii(t):
    pats = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    luhn = lambda s: sum((x - 9 if x > 9 else x) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0
    out = []
    for kind, p in pats.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_spans(spark, odd, none, texts):
    nasty = ["a@b.c_d@e.f", "a@b..c", "@x.y a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.02.3.255", f"x{CARD}x {CARD}0 4111-1111-1111-1111",
             "+1 (234) 567-89 +12", "++46 701234567)", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "é café@mail.se \U0001F600 9.9.9.9"]
    more = {**texts, **{100_000 + k: t for k, t in enumerate(nasty)}}
    got = rows(pii.find_pii(spark.createDataFrame(list(more.items()), "doc_id long, text string")))
    for i, t in more.items():
        base = brute_pii(t)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (i, got[i]["spans"], base)
        assert got[i]["n_email"] == base.count("email:") and got[i]["spans"].startswith(base)
    assert pii.find_pii(odd).count() == len(ODD) and pii.find_pii(none).count() == 0
    long = spark.createDataFrame([(1, "9" * 200_000 + " " + "a" * 200_000 + "@" + "b." * 20_000)], "doc_id long, text string")
    assert pii.find_pii(long).count() == 1


def test_pii_disclosing_terms(spark):
    docs = [(k, f"word{k} other{k % 3} said zanzibar mail to eve@example.org today") for k in range(6)]
    docs += [(100 + k, f"word{k} other{k % 3} said plain things to all today number{k}") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(pii.find_pii(df))
    t = docs[0][1]
    at = t.index("zanzibar")
    assert f"removed:{at}:{at + 8}" in got[0]["spans"] and "said" not in {t[int(a) : int(b)] for _, a, b in (s.split(":") for s in got[0]["spans"].split(","))}
    assert got[100]["spans"] == ""
    clean = rows(pii.sanitise(df))
    assert "zanzibar" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"] and clean[100]["text"] == docs[6][1]


def test_pii_one_text_is_no_evidence_but_a_pool_is(spark):
    docs = [(0, "said qwertal of zanzibar mail to eve@example.org or adam@example.org today"), (1, "said zanzibar mail to bob@example.org today")]
    docs += [(100 + k, f"said mail to all today number{k} zan") for k in range(60)]
    got = rows(pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")))
    marked = lambda i: {docs[i][1][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i]["spans"].split(",")) if k in ("term", "removed")}
    assert marked(0) == {"zanzibar"} and marked(1) == {"zanzibar"}
    assert got[100]["spans"] == ""


def test_pii_broader_form(spark):
    docs = [(k, f"Zanzibar and kilimanjaro mail eve{k}@example.org") for k in range(4)] + [(50 + k, f"zander number{k}") for k in range(9)]
    docs += [(100 + k, f"and plain mail example org number{k}") for k in range(60)]
    clean = rows(pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")))
    # "zan*" is met without the domain too, "kil*" is not.
    assert clean[0]["text"] == "zan* and [REMOVED] mail [EMAIL]" and clean[50]["text"] == "zander number0"


def brute_term_spans(texts):
    """Method spans of different texts by dictionaries: {text: {(kind, start, end)}}."""
    low = lambda k, n: (k / n + Z2 / (2 * n) - Z2**0.5 * math.sqrt(k / n * (1 - k / n) / n + Z2 / (4 * n * n))) / (1 + Z2 / n)
    Z2 = pii.Z**2
    every, base, terms, names = set(texts), {}, {}, {}
    broad = lambda w: w[:3] + "*" if len(w) > 3 else None
    for t in every:
        base[t] = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in brute_pii(t).split(",") if s)]
        words = {w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t)}
        terms[t] = words | {broad(w) for w in words if broad(w)}
        names[t] = set()
        for k, a, b in base[t]:
            v, d = t[a:b].lower(), re.sub("[^0-9]", "", t[a:b])
            pool = {"email": v.rsplit("@", 1)[-1], "ip": ".".join(v.split(".")[:3])}.get(k, d[:6])
            names[t] |= {(k, d if k in ("card", "phone") else v), ("pool", k, pool)}
            if k == "email":
                names[t] |= {("name", x) for x in re.split("[^a-z]+", v.split("@")[0]) if len(x) >= 3}
    n_t = Counter(x for t in every for x in terms[t])
    n_e = Counter(e for t in every for e in names[t])
    n_te = Counter((x, e) for t in every for e in names[t] for x in terms[t])
    tells = {(x, e) for (x, e), k in n_te.items() if n_e[e] < len(every) and low(k, n_t[x]) >= 2**-pii.BITS}
    out = {}
    for t in every:
        shown = {x for x in terms[t] if any((x, e) in tells for e in names[t])}
        out[t] = set()
        for m in regex.finditer(r"[\p{L}\p{N}]+", t):
            w = m.group().lower()
            if w in shown and not any(a < m.end() and b > m.start() for _, a, b in base[t]):
                out[t].add(("term" if broad(w) and broad(w) not in shown else "removed", m.start(), m.end()))
    return out


def test_pii_term_spans_against_dictionaries(spark, texts):
    rng = random.Random(5)
    words = ["ana", "anabel", "anatol", "bo", "borneo", "born", "cee", "x", "zanzibar", "zander", "mail", "to"]
    data = []
    for k in range(250):
        who = f"{rng.choice(['jan.roe', 'ida', 'kim_lee'])}@{rng.choice(['a.org', 'b.org', 'c.net'])}"
        picked = rng.choices(words, k=rng.randint(1, 6)) + ([who] if rng.random() < 0.4 else []) + ([f"10.0.{rng.randint(0, 3)}.{k}"] if rng.random() < 0.2 else [])
        if who in picked and "a.org" in who:
            picked += rng.choices(["anabel", "quito", "zanskar"], k=2)
        data.append(" ".join(rng.sample(picked, len(picked))))
    for batch in (data, [t or "" for t in texts.values()]):
        want = brute_term_spans(batch)
        got = rows(pii.find_pii(spark.createDataFrame(list(enumerate(batch)), "doc_id long, text string")))
        seen = set()
        for i, t in enumerate(batch):
            spans = [s.split(":") for s in got[i]["spans"].split(",") if s]
            mine = {(k, int(a), int(b)) for k, a, b in spans if k in ("term", "removed")}
            assert mine == want[t], (t, mine, want[t])
            seen |= {k for k, _, _ in mine}
        if batch is data:
            assert seen == {"term", "removed"}


def test_pii_spans_by_kind_then_start(spark):
    docs = [(k, f"topaz near zanzibar mail eve@example.org or 10.0.0.{k} zanzibar topaz") for k in range(6)] + [(50, "topology alone on this day")]
    docs += [(100 + k, f"plain things to all today number{k} topic{k}") for k in range(300)]
    got = rows(pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")))
    order = ["email", "ip", "card", "phone", "removed", "term"]
    for r in got.values():
        spans = [(order.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert spans == sorted(spans)
    assert {s.split(":")[0] for s in got[0]["spans"].split(",")} == {"email", "ip", "removed", "term"}


def test_pii_copies_change_no_disclosure(spark):
    once = [f"said zanzibar mail to eve@example.org number{k}" for k in range(3)] + [f"said plain mail to all today number{k}" for k in range(60)]
    docs = [(k, t) for k, t in enumerate(once)] + [(1000 + 100 * c + k, once[k]) for c in range(20) for k in range(3)]
    got = rows(pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")))
    at = once[0].index("zanzibar")
    for i in (0, 1, 2, 1000, 2902):
        assert f"removed:{at}:{at + 8}" in got[i]["spans"].split(",")


def test_sanitise_leaves_no_base_span(spark, odd):
    out = pii.sanitise(odd)
    assert out.columns == odd.columns
    six = [r["text"] for r in out.collect() if r["doc_id"] == 6][0]
    assert brute_pii(six) == "" and six.startswith("mail [EMAIL] or [CARD]")


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores(spark, texts, order):
    flags = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    df = spark.createDataFrame([(i, t, flags[i]) for i, t in texts.items()], "doc_id long, text string, held_out boolean")
    seq = {i: ["<s>", *WORD.findall(fold(t)), "</s>"] for i, t in texts.items()}
    count = [Counter() for _ in range(order + 1)]
    for i, s in seq.items():
        if not flags[i]:
            for k in range(1, order + 1):
                count[k].update(tuple(s[j : j + k]) for j in range(len(s) - k + 1))
    n = sum(c for g, c in count[1].items() if g != ("<s>",))
    v = len(count[1]) - 1
    got = rows(lm_score.lm_scores(df, order=order))
    for i, s in seq.items():
        base = total = 0.0
        for j in range(1, len(s)):
            p = (count[1][(s[j],)] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(2, min(order, j + 1) + 1):
                g = tuple(s[j - k + 1 : j + 1])
                p = (count[k][g] + 50 * p) / (count[k - 1][g[:-1]] + 50)
            total += math.log10(p)
        r = got[i]
        assert r["train_tokens"] == n and r["n_tokens"] == len(s) - 1
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], total, rel_tol=1e-9)


def test_lm_odd_rows(spark, odd, none):
    from pyspark.sql import functions as F

    got = lm_score.lm_scores(odd.withColumn("held_out", F.lit(False))).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert lm_score.lm_scores(none.withColumn("held_out", F.lit(True))).count() == 0
    assert lm_score.lm_scores(odd.withColumn("held_out", F.lit(True))).filter("n_known > 0 or train_tokens > 0").count() == 0


def test_pack_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        key = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (lm_score.unpack(lm_score.pack(key)) == key).all()
    key = np.sort(rng.integers(1 << 62, (1 << 62) + (1 << 40), 500, dtype=np.uint64))
    assert (lm_score.unpack(lm_score.pack(key)) == key).all()


def test_token_counts(spark, odd, none, texts):
    c = token_counts.counter(token_counts.default_vocabulary())
    count = lambda t: len(c.lib.encode(t, add_special_tokens=False).ids)
    odd_texts = ["a  b\n\n c", "don't we'll 'r 're", "<|endoftext|> x  <|endoftext|>", "　\x85 日本語 \U0001F600!!", "x" * 60]
    more = {**texts, **{100_000 + k: t for k, t in enumerate(odd_texts)}}
    got = rows(token_counts.token_counts(spark.createDataFrame(list(more.items()), "doc_id long, text string"), tables=True))
    for i, t in more.items():
        r = got[i]
        assert r["n_tokens"] == count(t) and r["n_bytes"] == len(t.encode()) and r["over_limit"] == (count(t) > 512)
        assert count(t[: r["cut_chars"]]) <= 512 and (r["unit_counts"] or [0])[-1] == r["n_tokens"]
    for t in odd_texts[:2] + odd_texts[3:]:
        assert [c.count_at(t, k) for k in range(len(t) + 1)] == [count(t[:k]) for k in range(len(t) + 1)]
    long = spark.createDataFrame([(1, "y" * 30_000)], "doc_id long, text string")
    assert token_counts.token_counts(long).first()["n_tokens"] == count("y" * 30_000)
    assert token_counts.token_counts(odd).count() == len(ODD) and token_counts.token_counts(none).count() == 0


def test_quality_rules(spark, odd, none, texts):
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    got = rows(quality_rules.quality_rules(df))
    for i, t in texts.items():
        w = WORD.findall(t or "")
        g = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(odd).count() == len(ODD) and quality_rules.quality_rules(none).count() == 0


def test_kneser_ney_is_normalised():
    import numpy as np
    import pyarrow as pa

    from spate.llm.common import TextBatch

    tb = TextBatch(pa.array(["the cat sat on the mat. the hat!", "a cat ate", None, ""]))
    m = quality_rules.KneserNey(*np.unique(quality_rules.codes(tb), return_counts=True))
    for context in (int(m.code[3][5]) >> 6, 12345):
        every = (np.uint32(context << 6) | np.arange(64, dtype=np.uint32)).astype(np.uint32)
        assert abs(np.exp(m.score(every)).sum() - 1) < 1e-6


def test_perplexity_is_of_the_text_itself():
    import pyarrow as pa

    from spate.llm.common import TextBatch

    # No two characters share their symbols, and none begins with all the symbols of another.
    chars = [chr(c) for c in [*range(0x3000), *range(0x4E00, 0x5200), *range(0xAC00, 0xAD00), *range(0x1F300, 0x1F700)]]
    code, bounds = quality_rules.coded(TextBatch(pa.array(chars)))
    symbols = [tuple(int(x) % 64 for x in code[a:b]) for a, b in zip(bounds, bounds[1:])]
    assert len(set(symbols)) == len(chars)
    known = set(symbols)
    assert not any(s[:k] in known for s in symbols for k in range(1, len(s)))


def test_perplexity_equals_a_restatement(spark):
    """Per text the log-probabilities of its symbols one by one, over its bytes."""
    import math

    import numpy as np
    import pyarrow as pa

    from spate.llm.common import TextBatch

    texts = ["Ab 12 åäö 中文!", "ab 12 aao 丮斈?", None, ""]
    tb = TextBatch(pa.array(texts))
    code, bounds = quality_rules.coded(tb)
    model = quality_rules.KneserNey(*np.unique(code, return_counts=True))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["log_ppl"] for r in quality_rules.measure(df, model).collect()}
    for i, t in enumerate(texts[:2]):
        want = -sum(float(model.score(np.array([c], dtype=np.uint32))[0]) for c in code[bounds[i] : bounds[i + 1]]) / len(t.encode())
        assert math.isclose(got[i], want, rel_tol=1e-12)
    assert got[2] is None and got[3] is None


def test_quality_rules_learns_every_language_and_applies_every_rule(spark):
    import random

    def text(words, i, more=()):
        r = random.Random(i)
        lines = [" ".join(r.choice(words) for _ in range(12)) for _ in range(8)]
        return "\n".join([*lines, *more])

    a = [x + y for x in ("ri", "sto", "mea", "win", "har", "gar") for y in ("ver", "ne", "dow", "ter", "bour", "den")]
    b = [x + y for x in ("zw", "vkj", "qqz", "xyw", "jkv", "wzy") for y in ("xqz", "yk", "vvj", "wqx", "zkk", "jjq")]
    rows_ = [(i, text(a, i), "x") for i in range(40)] + [(100 + i, text(b, i), "y") for i in range(40)]
    rows_ += [(200 + i, text(b, 50 + i), None) for i in range(40)] + [(300 + i, text(a, 50 + i), "") for i in range(40)]
    odd_ones = {
        400: text(b, 90), 401: text(a, 91, [" ".join(["#$%&"] * 40)]), 402: text(a, 92, [w for w in a[:3] for _ in range(9)]),
        403: " ".join(w * 9 for w in text(a, 93).split()),
    }
    df = spark.createDataFrame(rows_ + [(i, t, "x") for i, t in odd_ones.items()], "doc_id long, text string, lang string")
    got = rows(quality_rules.quality_rules(df))
    assert all(got[i]["kept"] for i, _, _ in rows_)
    # Another language's text, symbols, repeated lines, long words.
    assert not any(got[i]["kept"] for i in odd_ones)
    assert got[401]["base_failed"] is False and got[403]["base_failed"] is False and got[400]["base_failed"] is False
    # The same rows when the languages are taken in turn.
    one = quality_rules.turns({"x": 5, None: 4, "": 3, "y": 3}, most=7)
    assert one == [["x"], [None, ""], ["y"]] and quality_rules.turns({}) == []


def test_quality_rules_in_turns(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i} of some words " * 20, lang) for i, lang in enumerate(["x", "", None, "x"])] + [(9, None, "z")], "doc_id long, text string, lang string")
    want = rows(quality_rules.quality_rules(df))
    turns = quality_rules.turns
    monkeypatch.setattr(quality_rules, "turns", lambda sizes: turns(sizes, most=1))
    assert rows(quality_rules.quality_rules(df)) == want and len(want) == 5


def test_quality_gam(spark, odd, none):
    good = lambda i: " ".join(f"word{(i * 3 + k) % 50} and" for k in range(40)) + "."
    docs = spark.createDataFrame([(i, good(i) if i % 3 else good(i).replace(" and", "$$$ ###")) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], LABELS)
    got = rows(quality_gam.classify(docs, labels))
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in range(200, 300))
    assert quality_gam.classify(odd, labels).count() == len(ODD) and quality_gam.classify(none, labels).count() == 0
    assert {r["score"] for r in quality_gam.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_mixing_budgets(spark, odd, none):
    docs = [(k, "w " * (1 + k % 7), "en" if k % 2 else "de", f"src{k % 10}") for k in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df).collect()
    total = sum(1 + k % 7 for k in range(500))
    used = sum(r["n_tokens"] for r in got)
    assert total // 2 - 20 * 8 <= used <= total // 2 and max(r["epoch"] for r in got) <= mixing.EPOCHS - 1
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    other = mixing.mix(df, seed=5).collect()
    assert {(r["doc_id"], r["epoch"]) for r in got} != {(r["doc_id"], r["epoch"]) for r in other}
    assert mixing.mix(none).count() == 0 and mixing.mix(odd).count() >= 1


def test_warc(spark):
    pages = [(1, "u1", "<p>same</p>", 0), (5, "u 5", "<p>same</p>", 0), (3, None, None, 0), (4, "u4", "", 0), (9, "u9", "é\r\n\r\nWARC/1.1\r\n", 0), (None, "n", "<p>same</p>", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha1 int")
    path = stage_path(spark, "warc-test")
    warc.write_archives(df, path)
    read = warc.read_archives(spark, path)
    got = rows(warc.page_digests(read), "page_id")
    assert got[5]["record_type"] == "response" and got[1]["refers_to"] == 5 and got[None]["refers_to"] == 5
    assert got[4]["record_type"] == "response" and got[3]["refers_to"] == 4 and got[3]["payload_bytes"] == 0
    assert got[9]["payload_bytes"] == len(pages[4][2].encode())
    blocks = {r["record_id"]: bytes(r["block"]).decode() for r in read.collect()}
    assert blocks[9] == pages[4][2] and blocks[1] == "" and read.filter("not digest_ok").count() == 0
    again = stage_path(spark, "warc-test")
    warc.dedupe_archives(spark, path, again)
    assert sorted(map(repr, warc.page_digests(warc.read_archives(spark, again)).collect())) == sorted(map(repr, got.values()))
    empty = stage_path(spark, "warc-test")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_pipeline(spark, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert toxic.columns == docs.columns and 0 < toxic.count() <= docs.count()
    one = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    want = {i for i, (_, c) in jaccard_components(texts).items() if c == i}
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == want
    free = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    hit = {r["doc_id"] for r in QUERIES["op1_decontaminate"](spark, SF).filter("contaminated").collect()}
    assert {r["doc_id"] for r in free.select("doc_id").collect()} == set(texts) - hit
    clean = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert clean.columns == docs.columns and all(brute_pii(r["text"]) == "" for r in clean.collect())
    assert corpus_pipeline.run(spark, SF).count() > 0
