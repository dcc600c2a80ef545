import hashlib
import math
import random
import re
import textwrap
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from salvora.llm import licenses, mixing, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# ------------------------------------------------------------------ licences


def slow_notice(line):
    """Whether a lower-cased line is a copyright line."""
    line = line.lstrip(" \t#*/;%!<>-")
    after = next((line[len(w) :] for w in ("copyright", "(c)", "©") if line.startswith(w)), None)
    if after is None:
        return line.startswith("all rights reserved") and not line[19:].strip(" \t\r.*/")
    year = any(after[i : i + 2] in ("19", "20") and after[i + 2 : i + 4].isascii() and after[i + 2 : i + 4].isdigit() and len(after[i + 2 : i + 4]) == 2 for i in range(len(after)))
    return year or line.startswith("©") or (line.startswith("copyright") and after.lstrip(" \t").startswith(("(c)", "©", "by ")))


def slow_canonical(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    text = "\n".join("" if slow_notice(line) else line for line in text.split("\n"))
    words = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f“”‘’–—©®«»]+", " ", text).split(" ")
    return " ".join(dict(licenses.EQUIVALENT).get(w, w) for w in words if w)


def test_licenses(spark):
    mit = "Copyright (c) 2020 Someone\n\nTHE MIT LICENCE\n" + licenses._MIT.upper()
    texts = [mit, licenses._MIT.replace("sublicense", "sublicence").replace(" ", "   "), licenses._MIT + " more", "body\nReleased under the MIT Licence!\nx", "Licensed under CC BY-NC 4.0.\nlicensed under CC BY 4.0", None, "", "favour favour licence licence", "(C) 1999 all\ncopyright gone\nkept", "Copyright by X\n © Y\n# copyright holders be\nAll rights reserved.\nall rights reserved to\n(c) you must\ncopyright 20x9\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("license", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.op3_licenses(df).collect()}
    assert [got[i].license for i in range(len(texts))] == ["MIT", "MIT", None, None, None, None, None, None, None, None]
    assert [got[i].notices for i in range(3, 7)] == ["MIT", "CC-BY-4.0,CC-BY-NC-4.0", "", ""] and got[4].n_notices == 2
    for i, t in enumerate(texts):
        assert got[i].text_digest == hashlib.sha256(slow_canonical(t).encode()).hexdigest()
    assert licenses.op3_licenses(df.limit(0)).count() == 0 and licenses.op3_licenses(df.union(df)).count() == 2 * len(texts)
    assert all("licen" in re.sub("licence", "license", n.lower()) for _, n in licenses.NOTICES)


def test_whole_licenses_in_other_dress(spark):
    """Texts as published: wrapped, with copyright lines, as comments, in capitals or British spelling; and nearly the same, which they are not."""
    isc = "\n\n".join(textwrap.fill(p, 78) for p in ("Copyright (c) 2011, 2012 Some One <one@example.org>", licenses._ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.", licenses._ISC_DISCLAIMER))
    assert any(line.startswith("copyright notice") for line in isc.split("\n"))
    bsd = "Copyright 1999-2003 The Authors.\nAll rights reserved.\n\n" + "\n".join(textwrap.fill(p, 72) for p in (licenses._BSD_HEAD + "\n" + licenses._BSD_THIRD + "\n" + licenses._BSD_TAIL).split("\n"))
    texts = {
        "ISC": [isc, "/*\n" + "\n".join(f" * {line}" for line in isc.split("\n")) + "\n */", "ISC LICENCE\n" + isc.upper(), "\n".join(f"# {line}" for line in isc.split("\n"))],
        "BSD-3-Clause": [bsd, "\n".join(f"// {line}" for line in bsd.split("\n")), bsd.replace("\n", "\r\n")],
        "MIT": [textwrap.fill("MIT Licence", 60) + "\n" + textwrap.fill(licenses._MIT.replace("sublicense", "sublicence"), 60).replace('"', "”")],
        None: [isc + "\nand more", isc.replace("without fee", "with fee"), bsd[: len(bsd) // 2], "x" * 500_000],
    }
    for name, published in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0")):
        path = Path("/usr/share/common-licenses") / published
        if path.is_file():
            texts[name] = [path.read_text(), "\n".join(f"# {line}" for line in path.read_text().split("\n"))]
    rows = [(i, name, t) for i, (name, t) in enumerate((name, t) for name, some in texts.items() for t in some)]
    got = {r.doc_id: r.license for r in licenses.op3_licenses(spark.createDataFrame(rows, "doc_id int, name string, text string")).collect()}
    assert got == {i: name for i, name, _ in rows}


# ------------------------------------------------------------------ URLs


def slow_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in url_filter.RULES for base in [r.split("/")[0]] if (host == base or host.endswith("." + base)) and path.startswith(r[len(base) :])]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def slow_held(folded):
    return hashlib.md5((folded + url_filter.SEED).encode()).hexdigest()[0] in "012"


def slow_verdicts(urls):
    fold = lambda u: re.sub(r"[^a-z0/.\-_?=&#:%+]", "~", re.sub("[0-9]", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in u or "")))
    grams = lambda u: [("^^" + fold(u) + "$")[i : i + 3] for i in range(len(fold(u)) + 1)]
    ruled = [slow_rule(u) for u in urls]
    n3 = {v: Counter(g for u, r in zip(urls, ruled) if r[3] == v and not slow_held(fold(u)) for g in grams(u)) for v in ("allow", "block")}
    size = len(url_filter.ALPHABET)

    def logp(v, g):
        total = lambda f: sum(n for k, n in n3[v].items() if f(k))
        p = (total(lambda k: k[2] == g[2]) + 1 / size) / (total(lambda k: True) + 1)
        p = (total(lambda k: k[1:] == g[1:]) + p) / (total(lambda k: k[1] == g[1]) + 1)
        return math.log((n3[v][g] + p) / (total(lambda k: k[:2] == g[:2]) + 1))

    score = [sum(logp("allow", g) - logp("block", g) for g in grams(u)) / len(grams(u)) for u in urls]
    held = [slow_held(fold(u)) for u in urls]
    known = [(math.floor(s * url_filter.STEPS), r[3]) for s, r, h in zip(score, ruled, held) if r[3] and h]
    if len({v for _, v in known}) < 2:
        known = [(math.floor(s * url_filter.STEPS), r[3]) for s, r in zip(score, ruled) if r[3]]
    good, bad = [s for s, v in known if v == "allow"], [s for s, v in known if v == "block"]
    least = None
    if good and bad:
        gain = {e: round(sum(s >= e for s in good) / len(good) + sum(s < e for s in bad) / len(bad), 9) for e, _ in known}
        best = [e for e in gain if gain[e] == max(gain.values())]
        least = (min(best) + max(best)) / 2 / url_filter.STEPS
    return [(*r[:3], r[3] or ("allow" if least is None or s >= least else "block")) for r, s in zip(ruled, score)]


def some_urls():
    rng = random.Random(2)
    hosts = ["a.example.org", "example.org", "b.com", "WWW.C.com", "d.net", "notorg", "x.fr.net", "example.org.net"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['/en/', '/es/', '/fr/', '/de/', '/', ''])}{rng.choice(['1', '22', 'x?y=/de/', '#q', 'é'])}" for _ in range(150)]
    return urls + [None, "", "no scheme", "://", "http://", "HTTP://Example.ORG/es/1", "ftp://org/", "http://example.org?x", *["http://d.net/spam"] * 20]


def test_urls_match_brute_force(spark):
    urls = some_urls()
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("score", F.lit(1))
    got = [tuple(r)[1:] for r in sorted(url_filter.op7_url_filter(df).collect(), key=lambda r: r.page_id)]
    assert got == slow_verdicts(urls)


@pytest.mark.parametrize("urls", [[], ["http://d.net/"], ["http://x.org/", "http://d.net/", None], ["http://b.com/de/", "http://d.net/"]])
def test_urls_without_labels_of_both_kinds(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in url_filter.op7_url_filter(df).collect()} == {i: slow_verdicts(urls)[i][3] for i in range(len(urls))}


# ------------------------------------------------------------------ mixing


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    """Cap, reshare the excess by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i if rng.random() > 0.05 else None, None if rng.random() < 0.05 else " ".join(["w"] * rng.choice((0, 1, 5, 40, 900 if rng.random() < 0.03 else 3))), "en", rng.choice([None, "", "a", "b", "hot", "hot", "hot", "hot", "é", "Z"]), 0) for i in range(200)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("range", F.lit(9))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = slow_targets(dict(sizes))
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", None)], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0), (0, 0.0, 0)]
