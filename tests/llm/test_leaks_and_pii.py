import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lakewright.llm import decontaminate as D
from lakewright.llm import pii

DOCS = "doc_id long, text string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(20))
def test_common_subsequence(seed):
    r = random.Random(seed)
    a = [r.randint(0, 9) for _ in range(r.randint(1, 90))]
    b = [r.randint(-1, 12) for _ in range(r.randint(0, 120))]
    assert D.common_subsequence(D.masks_of(a), len(a), b) == lcs(a, b)


def corpus(seed=0, items=30, docs=200):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ke", "li", "mo", "nu", "ra", "si"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    bench = [(i, text(r.randint(10, 30)).capitalize() + " " + text(r.randint(5, 20)).capitalize()) for i in range(items)]
    rows, want = [], set()
    for d in range(docs):
        body = [text(r.randint(5, 40)) for _ in range(r.randint(1, 12))]
        kind = d % 10
        if kind < 4:
            item, passage = r.choice(bench)
            w = passage.split()
            if kind == 1:
                passage = passage.upper().replace(" ", "  ")
            if kind == 2:
                for _ in range(len(w) // 8):
                    w[r.randrange(len(w))] = word()
                passage = " ".join(w)
            if kind == 3:
                w = [x for i, x in enumerate(w) if i % 8 != 3]
                passage = " ".join(w)
            body.insert(r.randint(0, len(body)), passage)
            want.add((d, item))
        rows.append((d, "\n".join(body)))
    return rows, bench, want


def test_planted_leaks_are_found_and_clean_texts_left(spark):
    rows, bench, want = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, items).collect()}
    assert got == want
    clean = D.decontaminate(docs, items)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want} and clean.columns == docs.columns


def test_candidates_keep_what_brute_force_finds(spark):
    rows, bench, _ = corpus(3, items=20, docs=80)
    index = D.fit(spark.createDataFrame(rows, DOCS), bench)
    found = total = 0
    for _, text in rows:
        hits = {h[0] for h in index.hits(text)}
        x = index.ids(text).tolist()
        for k, item in enumerate(index.item_ids):
            best = max(lcs(item, x[s : s + 2 * len(item)]) for s in range(0, max(1, len(x)), 4)) / len(item)
            if best >= 0.9:
                total += 1
                found += index.items[k] in hits
    assert total > 10 and found / total >= 0.9


def test_leaks_of_a_large_block_are_found_among_rare_words(spark):
    r = random.Random(11)
    rare = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    vocabulary = rare(3_000)
    bench = [(i, " ".join(r.choices(vocabulary, k=r.randint(14, 59)))) for i in range(D.ITEM_BLOCK)]
    rows = [(i, " ".join([*rare(60), bench[i][1], *rare(60)])) for i in range(0, D.ITEM_BLOCK, 4)]
    rows += [(1000 + i, " ".join(r.choices(vocabulary, k=200))) for i in range(400)]
    docs, items = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((rows, "doc_id"), (bench, "item_id")))
    got = {(h["doc_id"], h["item_id"]) for h in D.leaks(docs, items).collect()}
    assert got == {(i, i) for i in range(0, D.ITEM_BLOCK, 4)}


def test_a_long_item_is_near_its_own_words(spark):
    r = random.Random(12)
    words = [f"w{r.randrange(10**9)}" for _ in range(1_300)]
    docs = [(0, " ".join(words[:1_000])), *((i, " ".join(words[1_000:])) for i in range(1, 40))]
    index = D.fit(spark.createDataFrame(docs, DOCS), [(7, docs[0][1]), (8, "one two three four five six seven")])
    text = " ".join(words[1_000:] + words[:1_000] + words[1_000:])
    _, _, item, cosine = index.candidates([index.ids(text)], least=-1.0)
    assert cosine[item == 0].max() > 0.6
    assert [(h[0], h[2]) for h in index.hits(text)] == [(7, 1.0)]


def reworded_corpus(seed=2):
    """Phrases of concepts, each concept written by either of two words."""
    r = random.Random(seed)
    phrases = [r.sample(range(1_600), 8) for _ in range(400)]
    said = lambda c: f"{'ab'[r.random() < 0.5]}{c}x"
    docs = [(d, " ".join(said(c) for _ in range(5) for c in r.choice(phrases))) for d in range(4_000)]
    bench = [(i, " ".join(f"a{c}x" for k in r.sample(range(400), 4) for c in phrases[k])) for i in range(10)]
    other = lambda i, w: w.replace("a", "b") if i % 5 in (0, 2, 3) else w
    leaks = [(9000 + i, " ".join(other(*w) for w in enumerate(text.split()))) for i, text in bench]
    return docs, bench, leaks


def test_paraphrases_by_other_words_are_found(spark):
    docs, bench, leaks = reworded_corpus()
    for (_, item), (_, text) in zip(bench, leaks):
        assert lcs(item.split(), text.split()) / len(item.split()) < D.LIKELY
    df = spark.createDataFrame(docs + leaks, DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(got & {(9000 + i, i) for i in range(10)}) >= 9
    assert not {d for d, _ in got if d < 9000}


def test_query_finds_what_comparing_all_pairs_finds(spark, sf_dir):
    """The registered query, and its candidates by cosine alone, against every item at every place of every text."""
    from lakewright.llm.common import table

    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    want = set()
    for d, text in texts:
        words = D.tokens(text)
        for i, item in items.items():
            own = D.tokens(item)
            if len(set(own) & set(words)) < D.least_words(len(own)) / max(own.count(w) for w in own):
                continue
            m, n = len(own), D.answer_words(item)
            for s in range(0, len(words), D.STRIDE):
                region = words[max(0, s - m) : s + D.PASSAGE + m]
                common = lambda part: D.common_subsequence(D.masks_of(part), len(part), region)  # noqa: B023, E731
                if D.passes(m, common(own) / m, common(own[m - n :]) / n):
                    want.add((d, i))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in D.query(spark, sf_dir).collect()}
    assert want and got == want
    index = D.fit(docs, list(items.items()))
    found = index.near([index.ids(t) for _, t in texts])
    near = {(d, index.items[k]) for (d, _), hits in zip(texts, found) for k in hits}
    assert len(near & want) >= 0.9 * len(want)


def test_leak_edges(spark, monkeypatch):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "tiny"), (None, "null id words here"), (1, "zulu yankee")]
    texts = [(1, None), (2, ""), (3, "x " * 50_000 + items[0][1]), (4, "alpha " * 1000), (None, items[0][1]), (6, "a tiny thing"), (7, items[0][1]), (7, items[0][1])]
    docs = spark.createDataFrame(texts, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([("3", 1), ("None", 1), ("6", 4), ("7", 1), ("7", 1)])
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in D.leaks(docs, bench).collect()) == want
    monkeypatch.setattr(D, "ITEM_BLOCK", 1)
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in D.leaks(docs, bench).collect()) == want
    assert D.leaks(docs.filter("false"), bench).count() == 0
    assert D.leaks(docs, bench.filter("false")).count() == 0
    assert D.decontaminate(docs, bench.filter("false")).count() == len(texts)


def replaced(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return [(r["text"], r["n_entities"]) for r in pii.replace_pii(df, **kw).orderBy("doc_id").collect()]


SHAPES = [
    ("mail jo.doe_7@mail3.example.com end", r"mail [a-z]{2}\.[a-z]{3}_\d@[a-z]{4}\d\.[a-z]{7}\.com end"),
    ("call +1 (217) 555-7713.", r"call \+1 \(\d{3}\) \d{3}-\d{4}\."),
    ("call (217) 555-7713", r"call \(\d{3}\) \d{3}-\d{4}"),
    ("ip 97.5.117.73!", r"ip \d\d\.\d\.\d{3}\.\d\d!"),
    ("card 4417744280351547 or 4417-7442-8035-1547", r"card \d{16} or \d{4}-\d{4}-\d{4}-\d{4}"),
    ("ssn 123-45-6789", r"ssn \d{3}-\d\d-\d{4}"),
    ("iban DE89 3704 0044 0532 0130 00", r"iban DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d"),
    ("Dear Mrs. Jane Smith,", r"Dear Mrs\. [A-Z][a-z]ne [A-Z][a-z]{2}th,"),
    ("Dear Mr. Smith,", r"Dear Mr\. [A-Z][a-z]{2}th,"),
    ("Здесь г-жа Иванова.", r"Здесь г-жа [А-Я][а-я]{4}ва\."),
]


@pytest.mark.parametrize(("text", "shape"), SHAPES)
def test_surrogates_keep_the_format(spark, text, shape):
    (new, n), = replaced(spark, [text])
    assert n >= 1 and new != text and re.fullmatch(shape, new), new


def test_clean_texts_stay(spark):
    clean = [None, "", "Version 2.0 of 1999", "1.2.3", "a@b", "token 04dbebab91ab85687d33eeaaf9ac699e1188f962", "mr smith", "x" * 100_000, "5551234"]
    assert replaced(spark, clean) == [(t, 0) for t in clean]


def test_coreference_and_distinctness(spark):
    r = random.Random(0)
    ips = [f"{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}" for _ in range(2_000)]
    texts = [f"from {a} to {b}" for a, b in zip(ips, reversed(ips))] + ["Mail A.B@x.com and a.b@X.com and A.B@X.COM"]
    out = replaced(spark, texts)
    new = {}
    for text, (done, n) in zip(texts[:-1], out):
        assert n == 2
        for old, made in zip(text.split()[1::2], done.split()[1::2]):
            assert new.setdefault(old, made) == made
    assert len(set(new.values())) == len(new) and not any(a == b for a, b in new.items())
    mails = re.findall(r"\S+@\S+", out[-1][0])
    assert len({m.lower() for m in mails}) == 1 and mails[2] == mails[2].upper() != mails[1]
    assert replaced(spark, texts[:5]) == replaced(spark, texts[:5]) != replaced(spark, texts[:5], key="other")


def test_writings_of_one_entity_stay_linked(spark):
    numbers = [
        ("+1 017 555 7713", "+1-017-555-7713"), ("+44 20 7946 0958", "+442079460958"), ("(217) 555-7713", "217.555.7713"),
        ("4111 1111 1111 1111", "4111111111111111"), ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"),
    ]
    names = ["Mr John Smith", "Mr Smith", "Dr. Smith", "Mr. JOHN SMITH", "Mr John Brown", "Mrs Jane Smith", "Mrs. Smith"]
    out = [t for t, _ in replaced(spark, [f"at {x} or" for pair in numbers for x in pair] + [f"at {x}, or" for x in names])]
    shape = lambda t: re.sub(r"\d", "0", re.sub(r"[A-Z]", "A", t))
    bare = lambda t: re.sub(r"[^A-Z0-9+]", "", t[3:-3])
    for i, (a, b) in enumerate(numbers):
        assert bare(out[2 * i]) == bare(out[2 * i + 1]) != bare(f"at {a} or")
        assert [shape(t) for t in out[2 * i : 2 * i + 2]] == [shape(f"at {x} or") for x in (a, b)]
    made = [t[3:-4].split() for t in out[2 * len(numbers) :]]
    assert [m[0] for m in made] == ["Mr", "Mr", "Dr.", "Mr.", "Mr", "Mrs", "Mrs."]
    (_, john, smith), (_, family), (_, doctor), (_, john2, smith2), (_, john3, brown), (_, jane, wife), (_, wife2) = made
    assert smith == family == doctor == smith2.title() == wife == wife2 and john == john2.title() == john3
    assert smith != brown and john != jane
    (home,), (abroad,) = (re.findall(r"[(\d][\d() -]+\d", t) for t in [x[0] for x in replaced(spark, ["at (217) 555-7713 or", "at +1 217 555 7713 or"])])
    assert re.sub(r"\D", "", abroad) == "1" + re.sub(r"\D", "", home)


def test_names_are_replaced_without_title_too(spark):
    text = "John Smith came. Mr John Smith-Jones and Mr John Smith met; Smith left, John Smith too, Smithson stayed."
    (new, n), = replaced(spark, [text])
    assert n == 5 and "Smith-" not in new and not re.search(r"\bSmith\b", new) and "John" not in new and new.endswith("Smithson stayed.")
    full = re.findall(r"(\w+ \w+th)\b", new)
    assert full[0] == full[-1] and f"Mr {full[0]} met" in new and f"; {full[0].split()[1]} left" in new


def feistel(values, tag, key):
    """The permutation again, in plain Python, of lists of (at, base, size)."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    shape = ",".join(f"{b}.{s}" for _, b, s in values)
    n, prefix = len(values), f"{key}\x1f{tag}\x1f{shape}"
    at = [a for a, _, _ in values]
    for j in range(2 * pii.ROUNDS + 1):
        if j == pii.ROUNDS:
            at = [(a + 1) % s if s else a for a, (_, _, s) in zip(at, values)]
            continue
        turn, sign = (j, 1) if j < pii.ROUNDS else (2 * pii.ROUNDS - j, -1)
        left = [(i < n // 2) == (turn % 2 == 0) for i in range(n)]
        seed = sha(f"{prefix}/{turn}/" + ",".join(str(a) if x else "" for a, x in zip(at, left)))
        stream = "".join(sha(f"{seed}{b}") for b in range(n // 16 + 1))
        at = [
            a if x or not s else (a + sign * int(stream[4 * i : 4 * i + 4], 16)) % s
            for i, (a, x, (_, _, s)) in enumerate(zip(at, left, values))
        ]
    return at


def test_query_matches_the_permutation_in_plain_python(spark):
    r = random.Random(5)
    ips = sorted({f"{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}" for _ in range(300)})
    out = [t for t, _ in replaced(spark, [f"from {ip} on" for ip in ips])]
    for ip, text in zip(ips, out):
        base = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        slots = [(int(o) - base[len(o)][0], *base[len(o)]) for o in ip.split(".")]
        at = feistel(slots, "ip", pii.KEY)
        assert text == "from " + ".".join(str(a + b) for a, (_, b, _) in zip(at, slots)) + " on"


def test_full_shapes_stay_distinct(spark):
    ips = [f"{a}.{b}.{c}.{d}" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(1, 10)][:6_000]
    out = [t.split()[1] for t, _ in replaced(spark, [f"ip {x} end" for x in ips])]
    assert len(set(out)) == len(ips) and all(a != b for a, b in zip(ips, out))
    mails = [f"{a}{b}@x.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"]
    made = [t for t, _ in replaced(spark, mails)]
    assert len(set(made)) == len(mails) and not any(a == b for a, b in zip(mails, made))
    said = spark.createDataFrame([(x,) for x in ips + mails + ["Mr Li", "Mr Lo", "Dr Иванов", "Dr Иванова"]], "found string")
    assert pii.clashes(said).count() == 0


def luhn_ok(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_check_digits_stay_right_or_wrong(spark):
    cards = ["4111111111111111", "5500005555555559", "4111111111111112", "1234567890123"]
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "DE88370400440532013000"]
    out = [t.split()[1] for t, _ in replaced(spark, [f"no {x} end" for x in cards + ibans])]
    assert [luhn_ok(x) for x in out[:4]] == [luhn_ok(x) for x in cards]
    ok = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert [ok(x) for x in out[4:]] == [ok(x) for x in ibans] == [True, True, False]
    assert not set(out) & set(cards + ibans) and [x[:2] for x in out[4:]] == ["DE", "GB", "DE"]


def test_pii_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "ip 1.2.3.4", 5, 6, 7, 8, 9)], "doc_id long, text string, _n int, _k int, _found int, n_entities int, _leaks int")
    row = pii.replace_pii(df).first()
    assert (row["_n"], row["_k"], row["_found"], row["n_entities"]) == (5, 6, 7, 1)
    assert D.decontaminate(df, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).first()["_leaks"] == 9


def test_pii_edges(spark):
    rows = [(1, "ip 1.2.3.4", "a"), (1, "ip 1.2.3.4", "a"), (1, "other 1.2.3.4", None), (None, "ip 1.2.3.4", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").withColumn("value", F.lit(7)).withColumn("pos", F.lit(7))
    out = pii.replace_pii(df)
    assert out.columns == [*df.columns, "n_entities"]
    found = out.collect()
    assert len(found) == 4 and len({r["text"].split()[1] for r in found}) == 1 and all(r["n_entities"] == 1 and r["value"] == 7 for r in found)
    assert pii.replace_pii(df.filter("false")).count() == 0
