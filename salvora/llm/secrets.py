"""Secret scans: candidate strings judged by a random forest that was trained on labelled findings.

Candidates are values that a word for a secret is set to, of any length and signs, long strings of key-like characters, tokens of several parts with dots, long words of letters,
digits and other signs, and private-key blocks. They may overlap; what the forest keeps of them is joined. The forest sees length, character classes and transitions, dictionary
coverage, path neighbours and the words before it, all over the whole candidate, and takes out false positives: identifiers, hashes of files, long words, paths, placeholders.
Labelled findings are (text, start, end, label); without any of one's own a seeded generator writes a set of the usual kinds of both.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvora.llm.trees import Forest

#: Characters of a key-like string, and of a word of all kinds of signs, that no word for a secret stands before.
LEAST, LEAST_MIXED = 16, 12
#: Findings the forest learns from at most; of more, a sample by a seeded hash.
MAX_FINDINGS = 20_000
GENERATED, SEED = 4500, 11
MASK = "[SECRET]"

_RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
_DOTTED = re.compile(r"[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{8,}){2,}")
_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)
_WORDS = re.compile(r"[A-Za-z][A-Za-z0-9]*")
_ALPHA = re.compile(r"[a-z]{3,}")

# What the name of a secret has in it, and the value after it.
STEMS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "authorization", "bearer")
_VALUE = re.compile("(?:" + "|".join(STEMS) + r""")[a-z0-9_\-]{0,40}["'`]?[ \t]*(?::=|=>|=|:)[ \t]*(?:bearer[ \t]+|basic[ \t]+)?(?:"([^\s"]+)"|'([^\s']+)'|`([^\s`]+)`|([^\s"'`,;]+))""", re.I)
# Words before secrets, words before strings that look like them, and prefixes of known kinds of keys.
KEY_WORDS = frozenset("token secret password passwd pwd key apikey api auth authorization bearer credential credentials access private client session signing jwt pat".split())
PLAIN_WORDS = frozenset("commit sha sha1 sha256 md5 checksum digest hash uuid guid id revision version integrity etag build image file path url href src index object tree blob".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ", "SG", "npm_", "hf_")
# Words by which the coverage of a string is measured.
DICTIONARY = frozenset("""the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who did its let put say she too use
about after again also back because been before being between both came come could each even every example first found from give good great hand have here high home house into just know large last life like line long
made make many might more most much must name never next number only other over part people place right same said should show side small some such take tell than that their them then there these they thing think this
those three through time under until very want water well went were what when where which while will with word work world would write year your access account action admin application array base block build cache call change
check class client close code command config connection content control copy count create current custom data database date debug default delete document element error event field file filter final form format function global group
handler header host image index info input install interface item json key layer level library link list load local lock login main manager message method model module node null object option order output package page parent
password path placeholder plugin point post process project property public query queue read record release remote request resource response result return root route sample schema script search secret section server service session
setting source stack start state static status storage stream string style submit system table target task template test text thread title token type update upload user value variable version view web window xml yaml""".split())


def _classes(s: str) -> list[int]:
    return [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in s]


def coverage(s: str) -> float:
    """Share of the characters that dictionary words cover, longest words first from the left."""
    low, covered, i = s.lower(), 0, 0
    while i < len(low):
        size = next((n for n in range(min(11, len(low) - i), 2, -1) if low[i : i + n] in DICTIONARY), 0)
        covered, i = covered + size, i + max(size, 1)
    return covered / max(1, len(s))


_VOWEL = frozenset("aeiouyAEIOUY")
_BRACKETS, _MARKS = frozenset("()[]{}<>$%"), frozenset("!@#$%^&*~?+=|")
NAMES = ("length", "digits", "upper", "lower", "other", "changes", "entropy", "hex", "vowels", "longest_letters", "distinct", "coverage", "slashes", "path", "quoted", "assigned", "key_words", "plain_words", "prefix", "run", "dashes", "block", "named", "brackets", "marks", "dots", "opens")


def features(text: str, start: int, end: int) -> list[float]:
    """Features of the candidate text[start:end], of all of it."""
    s = text[start:end]
    n = len(s)
    kinds = _classes(s)
    chars = Counter(s)
    counts = np.array(list(chars.values())) / n
    before = text[max(0, start - 60) : start]
    near = [w.lower() for w in _WORDS.findall(before)[-4:]]
    near += [p for w in near for p in w.split("_")]
    letters = [len(x) for x in re.findall(r"[A-Za-z]+", s)]
    longest_run = max(len(m.group()) for m in re.finditer(r"(.)\1*", s, re.S))
    after = text[end : end + 1]
    last = before[-1:]
    total = lambda some: sum(chars[c] for c in some)
    return [
        math.log(n), kinds.count(2) / n, kinds.count(1) / n, kinds.count(0) / n, kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, float(-(counts * np.log2(counts)).sum()), float(all(c in "0123456789abcdefABCDEF" for c in chars)),
        total(_VOWEL) / max(1, sum(letters)), max(letters, default=0) / n, len(chars) / min(n, 64), coverage(s),
        s.count("/"), float(last in ("/", ".", "\\") or after in ("/", "\\") or bool(re.search(r"://\S*$", before))), float(last in ("'", '"', "`")),
        float(bool(re.search(r"[=:]\s*['\"`]?$", before))), float(sum(w in KEY_WORDS for w in near)), float(sum(w in PLAIN_WORDS for w in near)),
        float(s.startswith(PREFIXES)), longest_run / n, s.count("-") + s.count("_"), float(s.startswith("-----BEGIN")),
        float(any(x in before[-50:].lower() for x in STEMS)), total(_BRACKETS) / n, total(_MARKS) / n, float(s.count(".")), float(s[0] in "$<{[(*%" or "env" in s.lower()),
    ]


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans, each once and from left to right, that the forest is to judge; null and empty texts have none.

    They are private-key blocks; values of any length and signs up to a space, a closing quote or a separator, that a name with one of STEMS is set to; key-like strings with a digit or
    letters of both cases; three or more such parts with dots between; long words with letters of both cases, digits and other marks.
    """
    if not text:
        return []
    blocks = [m.span() for m in _BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    out, at = set(blocks), 0
    low = text.lower()
    if any(stem in low for stem in STEMS):
        for m in _VALUE.finditer(text):
            out.add(m.span(m.lastindex))
    for word in text.split():
        if len(word) < LEAST_MIXED:
            continue
        at = text.index(word, at)
        if len(word) >= LEAST:
            for m in (*_RUN.finditer(word), *(_DOTTED.finditer(word) if "." in word else ())):
                s = m.group()
                if any(c.isdigit() for c in s) or (any(c.isupper() for c in s[1:]) and any(c.islower() for c in s)):
                    out.add((at + m.start(), at + m.end()))
        if any(c in _MARKS for c in word):
            bare = word.strip("\"'`.,;:()[]{}<>")
            first = at + word.index(bare)
            if len(bare) >= LEAST_MIXED and {0, 1, 2} <= set(_classes(bare)) and any(c in _MARKS for c in bare):
                out.add((first, first + len(bare)))
        at += len(word)
    return sorted((a, b) for a, b in out if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in blocks))


def generated(n: int = GENERATED, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """n labelled findings (text, start, end, label) of the usual kinds of secrets and of strings that are none."""
    rng = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda chars, size: "".join(rng.choice(chars) for _ in range(size))
    words = sorted(DICTIONARY)
    syllables = [c + v for c in "bdfghklmnprstvwz" for v in ("a", "e", "i", "o", "u", "an", "er", "in", "on", "ou")]
    prose = lambda k: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k))
    b64 = alnum + "+/"
    secrets = (
        lambda: draw(hexa, rng.choice((32, 40, 40, 64))), lambda: "AKIA" + draw(alnum[26:], 16), lambda: "ghp_" + draw(alnum, 36), lambda: "sk_live_" + draw(alnum, 24),
        lambda: draw(b64, 40), lambda: draw(alnum, rng.randint(20, 48)), lambda: "xoxb-" + draw("0123456789", 12) + "-" + draw(alnum, 24), lambda: "eyJ" + draw(b64, rng.randint(30, 120)), lambda: draw(b64, 43) + "=", lambda: "AIza" + draw(alnum + "_-", 35), lambda: draw(b64, int(2 ** rng.uniform(6, 11))),
    )
    plain = (
        lambda: draw(hexa, 40), lambda: draw(hexa, 32), lambda: draw(hexa, 64), lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "_".join(rng.choice(words) for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 99)),
        lambda: "".join(rng.choice(words).title() for _ in range(rng.randint(3, 6))), lambda: draw("0123456789", rng.randint(16, 24)), lambda: "/".join(rng.choice(words) for _ in range(rng.randint(3, 6))) + "/" + str(rng.randint(1, 999)),
        lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(7, 12))).title() + rng.choice(("", "-")) + "".join(rng.choice(syllables) for _ in range(3)).title(), lambda: rng.choice("xX0A") * rng.randint(16, 40) + "1", lambda: "YOUR_" + "_".join(rng.choice(words).upper() for _ in range(3)) + "_1", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-{rng.randint(10, 59)}",
    )
    marks = "!@#$%^&*?+=~"
    spoilt = lambda: "".join(rng.choice((c, c, c.upper(), {"a": "4", "e": "3", "o": "0", "i": "1", "s": "$"}.get(c, c))) for c in "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))))
    shuffled = lambda parts: "".join(rng.sample(parts, len(parts)))
    passwords = (
        lambda: rng.choice(words) + draw("0123456789", rng.randint(1, 4)) + draw(alnum, rng.randint(1, 3)), lambda: spoilt() + draw("0123456789", rng.randint(1, 3)) + rng.choice(marks), lambda: spoilt() + rng.choice(marks) + draw("0123456789", rng.randint(1, 4)),
        lambda: draw(alnum + marks, rng.randint(8, 24)), lambda: draw(alnum, rng.randint(7, 15)), lambda: shuffled([rng.choice(words).title(), rng.choice(marks), draw("0123456789", rng.randint(2, 4)), rng.choice(marks), rng.choice(words).title()]),
        lambda: draw(hexa, rng.randint(8, 16)), lambda: rng.choice(words).title() + draw("0123456789", rng.randint(3, 6)),
    )
    values = (
        lambda: rng.choice(words), lambda: rng.choice(words) + rng.choice((".", ",", ")", "")), lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))), lambda: rng.choice(("null", "None", "true", "false", "required", "string", "str", "optional", "undefined", "yes", "no", "here", "see")),
        lambda: draw("0123456789", rng.randint(1, 5)), lambda: rng.choice("*xX.-") * rng.randint(3, 14), lambda: "${" + rng.choice(words).upper() + "_" + rng.choice(words).upper() + "}", lambda: "<" + rng.choice(words) + "-" + rng.choice(words) + ">", lambda: "{{" + rng.choice(words) + "." + rng.choice(words) + "}}",
        lambda: "os.environ[" + rng.choice(words).upper() + "]", lambda: "process.env." + rng.choice(words).upper(), lambda: "get" + rng.choice(words).title() + rng.choice(words).title() + "()", lambda: rng.choice(words) + "." + rng.choice(words) + "." + rng.choice(words), lambda: "/" + rng.choice(words) + "/" + rng.choice(words) + "/" + rng.choice(words),
        lambda: rng.choice(words) + "_" + rng.choice(words), lambda: draw(alnum, rng.randint(1, 3)), lambda: "https://" + rng.choice(words) + ".example.com/" + rng.choice(words), lambda: "your-" + rng.choice(words) + "-here", lambda: "%(" + rng.choice(words) + ")s",
    )
    dotted = (lambda: "eyJ" + draw(alnum, rng.randint(17, 33)) + "." + draw(alnum + "_-", rng.randint(30, 90)) + "." + draw(alnum + "_-", 43), lambda: draw(alnum, 24) + "." + draw(alnum, 8) + "." + draw(alnum + "_-", 27))
    domains = (lambda: ".".join("".join(rng.choice(syllables) for _ in range(5)) for _ in range(3)) + str(rng.randint(0, 9)), lambda: ".".join(rng.choice(words).title() + rng.choice(words).title() + rng.choice(words).title() for _ in range(3)))
    name = lambda pool: rng.choice(sorted(pool))
    given = lambda: rng.choice((f"{rng.choice(STEMS)} = \"", f"{rng.choice(STEMS)}: ", f"{rng.choice(STEMS).upper()}=", f'"{rng.choice(STEMS)}": "', f"{rng.choice(words)}_{rng.choice(STEMS)} = '", f"{rng.choice(STEMS)}: '"))
    key_heads = (lambda: f'{name(KEY_WORDS)} = "', lambda: f"{name(KEY_WORDS)}: ", lambda: f"{name(KEY_WORDS).upper()}_KEY=", lambda: f"Authorization: Bearer ", lambda: f"my {name(KEY_WORDS)} is ", lambda: f'"{name(KEY_WORDS)}": "', lambda: f"{name(KEY_WORDS)} ")  # noqa: F541
    plain_heads = (lambda: f"{name(PLAIN_WORDS)} ", lambda: f"{name(PLAIN_WORDS)}: ", lambda: f'{name(PLAIN_WORDS)} = "', lambda: "https://example.com/" + rng.choice(words) + "/", lambda: "", lambda: "", lambda: "./")
    out = []
    for _ in range(n):
        good, kind = rng.random() < 0.5, rng.random()
        if kind < 0.3:  # a value of a name for secrets
            body, head = rng.choice(passwords if good else values)(), given()
        elif kind < 0.36:
            body, head = rng.choice(dotted if good else domains)(), rng.choice((*key_heads, lambda: "") if good else plain_heads)()
        elif kind < 0.4:  # a word of all kinds of signs, with no name
            body = draw(alnum + marks, rng.randint(14, 30)) + "aZ7!" if good else "https://" + rng.choice(words) + ".example.com/" + rng.choice(words).title() + "?" + rng.choice(words) + "=" + str(rng.randint(0, 99))
            head = ""
        elif good:
            body, head = rng.choice(secrets)(), rng.choice(key_heads)()
            if body.startswith(PREFIXES) and rng.random() < 0.4:
                head = ""
        else:
            body, head = rng.choice(plain)(), rng.choice(plain_heads)()
            if not re.fullmatch("[0-9a-f]{32,}", body) and rng.random() < 0.3:  # no secret even after a word for one
                head = rng.choice(key_heads)()
        lead = prose(rng.randint(1, 12)) + " "
        if rng.random() < 0.2:
            lead = ""
        tail = (head[-1:] if head.endswith(("'", '"')) else "") + " " + prose(rng.randint(1, 8))
        out.append((lead + head + body + tail, len(lead + head), len(lead + head + body), int(good)))
    return out


@cache
def default_forest() -> Forest:
    return train(generated())


def train(findings: list[tuple[str, int, int, int]], max_findings: int = MAX_FINDINGS, seed: int = SEED) -> Forest:
    """A forest from labelled findings (text, start, end, label); of more than max_findings, those with the least seeded hashes."""
    if len(findings) > max_findings:
        findings = sorted(findings, key=lambda f: (xxhash.xxh64_intdigest(f"{f[1]}:{f[2]}:{f[0]}".encode("utf-8", "surrogatepass"), seed), f))[:max_findings]
    x = np.array([features(t, a, b) for t, a, b, _ in findings], dtype=float)
    return Forest().fit(x, np.array([label for *_, label in findings], dtype=float))


def find(text: str | None, forest: Forest, threshold: float = 0.5) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of candidates of a whole text, and (start, end, score) of those the forest keeps, from left to right; where these overlap, they are one, with the best score."""
    spans = candidates(text)
    if not spans:
        return 0, []
    p = forest.predict(np.array([features(text, a, b) for a, b in spans]))
    kept: list[tuple[int, int, float]] = []
    for (a, b), score in zip(spans, p):
        if score < threshold:
            continue
        if kept and a < kept[-1][1]:
            kept[-1] = (kept[-1][0], max(b, kept[-1][1]), max(kept[-1][2], round(float(score), 4)))
        else:
            kept.append((a, b, round(float(score), 4)))
    return len(spans), kept


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_candidates, secrets array<struct<start, end, score>>) for every row of docs; code points, end exclusive.

    Null and empty texts have no candidates. Texts are scanned whole, in time that grows with their length. Scores that tie with the threshold are kept. Repeated rows each give a row; an
    empty table gives none; other columns play no part.
    """
    forest = forest or default_forest()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [find(t.as_py(), forest, threshold) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([[{"start": a, "end": b, "score": s} for a, b, s in f] for _, f in got], kind)], names=["doc_id", "n_candidates", "secrets"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_candidates bigint, secrets array<struct<start:bigint,end:bigint,score:double>>")


def masked(text: str | None, forest: Forest, threshold: float = 0.5, mask: str = MASK) -> str | None:
    for a, b, _ in reversed(find(text, forest, threshold)[1]):
        text = text[:a] + mask + text[b:]
    return text


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, mask: str = MASK) -> DataFrame:
    """docs with every secret in text replaced by mask, and n_chars, where there is such a column, counted anew; null texts stay null, rows and columns as they are."""
    forest = forest or default_forest()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, forest, threshold, mask))

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets and spans (start:end, comma-joined) for all documents."""
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scan(docs).select("doc_id", "n_candidates", F.size("secrets").cast("bigint").alias("n_secrets"), spans.alias("spans"))
