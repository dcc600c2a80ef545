import hashlib
import math
import random
import re

from salvora.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def slow_base(text):
    text = text or ""
    out = {"email": [m.span() for m in EMAIL.finditer(text)]}
    out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out["card"] = [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and slow_luhn(digits(m))]
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


def texts():
    rng = random.Random(3)
    atoms = ["a@b.co", "x_y%+@d-e.f.g", "@", ".", "..", "_x@y.z", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "4539 5787 6362 1486", "4539578763621486", "6011-0009-9013-9424", "1", "12", " ", "  ", "-", "+1 (377) 555-0271", "+49", "++1234567890", "é", "𝒳", "\n", "word", "+1234567", "+12345678901234567", "3.4.5.6.7.8.9.10", "79927398713"]
    out = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    out += ["".join(rng.choice("01 -.+@a()") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + [None, "", "a" * 2000, "1" * 2000, "1 " * 2000, "a@" * 2000, "1." * 2000, "+1(" * 2000]


def test_base_spans_match_python(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {r.doc_id: r for r in pii.op5_pii(df).collect()}
    for i, text in rows:
        want = slow_base(text)
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.KINDS], (i, (text or "")[:200])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans == joined or r.spans.startswith(joined)


def test_runs_of_one_character_take_linear_time(spark):
    rows = [(i, t) for i, t in enumerate(["a" * 200_000, "1" * 200_000, "1 " * 60_000, "a@" * 50_000, "+1(" * 30_000])]
    got = pii.op5_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 5 and all(r.spans == "" for r in got)


def slow_terms(rows):
    """Disclosing words by the definition, in plain Python."""
    n, df_t, df_e, both, near = len(rows), {}, {}, {}, []
    word = re.compile(r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])")
    for text in rows:
        text = text or ""
        for w in {m.group().lower() for m in word.finditer(text)}:
            df_t[w] = df_t.get(w, 0) + 1
        spans = [s for k in pii.KINDS for s in slow_base(text)[k]]
        free = [m.span() for m in word.finditer(text) if not any(m.start() < y and x < m.end() for x, y in spans)]
        close = {(text[a:b], text[s:e].lower(), s, e) for a, b in spans for s, e in free}
        for e in {text[a:b] for a, b in spans}:
            df_e[e] = df_e.get(e, 0) + 1
        for p in {(e, t) for e, t, *_ in close}:
            both[p] = both.get(p, 0) + 1
        near.append(close)
    out = []
    for close in near:
        best = {}
        for e, t, s, x in close:
            if both[e, t] >= pii.SUPPORT and n > df_e[e]:
                share = math.log2(both[e, t] * n / (df_t[t] * df_e[e])) / math.log2(n / df_e[e])
                if share >= pii.GENERALISE:
                    best[s, x] = max(share, best.get((s, x), 0))
        out.append(sorted(("remove" if v >= pii.REMOVE else "generalise", *k) for k, v in best.items()))
    return out


def test_terms_match_brute_force_and_text_is_sanitised(spark):
    rng = random.Random(8)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda", "ab", "x1y", "quarrel7", "4quarrel"]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if i % 6 == 0:
            words.insert(rng.randint(0, len(words)), "nickname jo.doe@mail.example.com quarrel")
        if i % 10 == 0:
            words.insert(rng.randint(0, len(words)), "+1 (377) 555-0271 harbour 10.0.0.1")
        rows.append(" ".join(words))
    rows += [None, "", rows[0], rows[0]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.sanitise(df, keep_text=True).collect()}
    want = slow_terms(rows)
    assert any(want)
    for i in range(len(rows)):
        assert [tuple(t) for t in got[i].terms] == want[i], rows[i]
    first = got[0]
    assert "jo.doe@mail.example.com" not in first.text and "[EMAIL]" in first.text and "nickname" not in first.text


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, terms int, row string")
    assert pii.op5_pii(df).count() == 0
    df = spark.createDataFrame([(None, "a@b.cd", 1, "x"), (None, "a@b.cd", 1, "x")], "doc_id bigint, text string, terms int, row string")
    assert [r.n_email for r in pii.op5_pii(df).collect()] == [1, 1]


def test_terms_far_from_an_entity(spark):
    far = " ".join(["filler"] * 40)
    rows = [f"quarrel {far} jo.doe@mail.example.com {far} quarrel and quarrel", f"jo.doe@mail.example.com {far} quarrel"] + [f"filler and other words {i}" for i in range(40)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), keep_text=True).collect()}
    assert [rows[0][t.start : t.end] for t in got[0].terms] == ["quarrel"] * 3 and all(t.action == "remove" for t in got[0].terms)
    assert "quarrel" not in got[0].text + got[1].text and not got[5].terms


def test_many_matches_in_one_text(spark):
    """Blocks of matches are put together, and time is about linear in them."""
    many = [" ".join(f"m{i}@h{i}.example.com and 10.0.{i % 256}.{i % 99} words" for i in range(n)) for n in (127, 128, 129, 6000)]
    got = {r.doc_id: r for r in pii.op5_pii(spark.createDataFrame(list(enumerate(many)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(many):
        want = slow_base(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k]).encode()).hexdigest()
