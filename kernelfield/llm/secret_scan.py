"""Secret scans: a random forest sorts out the false positives among candidate strings.

Candidates are proposed widely, and may overlap: runs of at least MIN_LENGTH characters of [A-Za-z0-9+/_-], shorter ones of 8 at
least with letters and digits, quoted or bare values of 4 to 200 characters after a credential word, passwords in URLs, dotted tokens and PEM
blocks as a whole. Overlapping secrets are joined. Features are length, character
shares and transitions, dictionary coverage, the path of the document and the words beside it. The forest is trained on
labelled findings: a table given by the caller (at most max_findings rows are used), or labelled_findings(), a seeded
set of known secret formats and known look-alikes in invented surroundings. Every text is scanned whole.

Defined cases: null and empty texts have no candidates; a null path has no path features; repeated rows give
repeated results; very long runs are one candidate; extra input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelfield.llm.common import mapped, table

MIN_LENGTH = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}")
_SHORT = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[+/_\-]*[A-Za-z+/_\-]*\d|\d+[+/_\-]*[A-Za-z])[A-Za-z0-9+/_\-]{8,15}(?![A-Za-z0-9+/_\-])")
_NAME = r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|key|auth(?:orization)?|credentials?|bearer)[A-Za-z0-9_\-]{0,20}[\"']?"
_ASSIGNED = re.compile(r"(?i)" + _NAME + r"(?=\s{0,3}(?:=>|:=|=|:|\s(?:is|was)\s|\s)\s{0,3}(?:\"([^\"\n]{4,200})\"|'([^'\n]{4,200})'|([^\s\"'<>]{4,200})))")
_NAMED = re.compile(r"(?i)" + _NAME + r"\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?$")
_URL = re.compile(r"://[^\s:/@\"']{1,64}:([^\s/@\"']{3,100})@")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{2,}(?:\.[A-Za-z0-9_\-]{4,}){2,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----[\s\S]{0,20000}?-----END \1-----")
#: Values that stand for a secret that is elsewhere.
_STANDIN = re.compile(r"(?i)[$%<{(\[]|^(?:os|process|config|settings|env|self|this|get\w*)\b|change_?me|your|example|placeholder|xxx|^(?:null|none|true|false|required|optional)$")
_WORDS = re.compile(r"[a-z]{3,}")
#: Words whose nearness speaks for a secret, and against one.
FOR = ("password", "passwd", "pwd", "secret", "token", "apikey", "api", "key", "auth", "credential", "bearer", "private", "access")
AGAINST = ("commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "example", "sample", "placeholder", "version", "revision", "integrity", "etag", "image", "href", "http", "https", "order", "isbn", "session")
#: Prefixes of issued keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "sk-", "sk_live_", "AIza", "glpat-", "npm_")
#: Words by which dictionary coverage is measured.
DICTIONARY = (
    "the and for with this that from have name user value file path test data list item index page image icon button default config setting option service server client request response handler manager factory "
    "controller module component window document element string number object array first last next previous north south east west summer winter house water light paper report meeting project example sample version release"
).split()
_DICT = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))
_TEST_PATH = re.compile(r"(?i)test|spec|fixture|example|sample|mock|doc|lock")
_CODE_PATH = re.compile(r"(?i)\.env|\.ya?ml|\.json|\.py|\.js|\.ini|config|settings|credential")
CONTEXT = 40
MARK = "[SECRET]"


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of the candidates."""
    found = {m.span() for p in (_CANDIDATE, _DOTTED, _PEM) for m in p.finditer(text)}
    found |= {m.span() for m in _SHORT.finditer(text) if any(c.isalpha() for c in m.group()) and any(c.isdigit() for c in m.group())}
    found |= {m.span(1) for m in _URL.finditer(text)}
    for m in _ASSIGNED.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 3:
            end = start + len(m[3].rstrip(".,;:!?)]}"))
        if end - start >= 4:
            found.add((start, end))
    blocks = [m.span() for m in _PEM.finditer(text)]  # judged as a whole
    return sorted(x for x in found if x in blocks or not any(a < x[1] and x[0] < b for a, b in blocks)) if blocks else sorted(found)


def features(value: str, before: str, after: str, path: str | None) -> list[float]:
    n = len(value)
    kinds = [1 if c.isdigit() else 2 if c.isupper() else 3 if c.islower() else 4 for c in value]
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    low = value.lower()
    near_before, near_after = before[-CONTEXT:].lower(), after[:CONTEXT].lower()
    words = set(_WORDS.findall(near_before)) | set(_WORDS.findall(near_after))
    last = near_before.rstrip(" \"'=:").rsplit(None, 1)[-1:] or [""]
    vowels = sum(c in "aeiou" for c in low)
    letters = max(1, sum(c.isalpha() for c in value))
    return [
        min(n, 200),
        kinds.count(1) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        kinds.count(4) / n,
        sum(c in "0123456789abcdef" for c in low) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(counts) / min(n, 64),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        sum(ord(b) - ord(a) in (0, 1) for a, b in zip(value, value[1:], strict=False)) / max(1, n - 1),
        vowels / letters,
        sum(len(x) for x in _DICT.findall(low)) / n,
        float(value.startswith(PREFIXES)),
        float(value.count("-") == 4 and n == 36),
        float(value.count("/")),
        float(near_before.rstrip(" \"'").endswith(("=", ":"))),
        float(before[-1:] in ("\"", "'")),
        float(any(x in last[0] for x in FOR)),
        float(any(x in words for x in FOR)),
        float(any(x in last[0] for x in AGAINST)),
        float(any(x in words for x in AGAINST)),
        float(bool(path and _TEST_PATH.search(path))),
        float(bool(path and _CODE_PATH.search(path))),
        float(value.count(".")),
        sum(not (c.isalnum() or c in "+/_-.") for c in value) / n,
        sum(c.isspace() for c in value) / n,
        float(value.startswith("eyJ")),
        float(value.startswith("-----BEGIN") and "PRIVATE KEY" in value[:60]),
        float(bool(_NAMED.search(near_before))),
        float("://" in near_before.rsplit(None, 1)[-1:][0] and after[:1] == "@" if near_before.strip() else 0),
        float(bool(_STANDIN.search(value[:200]))),
        float(len(set(kinds))),
        float(any(a == 3 and b == 2 for a, b in zip(kinds, kinds[1:], strict=False))),
    ]


def labelled_findings(n: int = 6000, seed: int = 20) -> list[tuple[str, str, str, str, int]]:
    """value, before, after, path, label (1: secret): secrets of known formats and look-alikes, in equal numbers."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choices(letters, k=k))
    hexa, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    prose = lambda: " ".join(pick(string.ascii_lowercase, r.randint(2, 9)) for _ in range(r.randint(2, 6)))
    out = []
    for i in range(n):
        left, right = prose() + r.choice([" ", ". ", ", ", "\n"]), r.choice([" ", ". ", ", ", "\n"]) + prose()
        path = r.choice(["src3", "app/config.yml", "web/settings.py", "notes.txt", "docs/page.html", "tests/test_io.py", "package-lock.json", ""])
        quote = r.choice(['"', "'", "", '"'])
        word = r.choice(DICTIONARY).capitalize()
        if i % 2:
            name = r.choice(["password", "token", "secret", "api_key", "apikey", "auth_token", "access_key", "passwd", "client_secret", "private_key"])
            join = r.choice(["=", " = ", ": ", ":", " : "])
            kind = r.randrange(13)
            if kind < 3:
                value, before, after = pick(hexa, r.choice([16, 18, 20, 24, 32, 40, 40, 64])), left + name + join + quote, quote + right
            elif kind == 3:
                value, before, after = r.choice(["AKIA", "AKIA", "ASIA"]) + pick(upper, 16), left + r.choice(["", "", "key ", "aws_access_key_id="]), right
            elif kind == 4:
                value, before, after = r.choice(PREFIXES[2:]) + pick(alnum, r.choice([20, 24, 36, 40])), left + r.choice(["", "", name + join + quote]), right
            elif kind == 5:
                value, before, after = pick(alnum + "+/", 40), left + name + join + quote, quote + right
            elif kind == 6:
                value, before, after = pick(alnum, r.randint(16, 48)), left + r.choice(["Bearer ", "authorization: ", name + join]) + quote, quote + right
            elif kind == 7:
                value, before, after = pick(alnum + "_-", r.randint(16, 40)), left + name + join + quote, quote + right
            elif kind == 8:  # short, often with other characters
                value, before, after = pick(alnum + r.choice(["", "!@#&*?^~.", "!@#&*?^~.:"]), r.randint(8, 15)), left + name + join + quote, quote + right
            elif kind == 9:  # a word disguised
                value = r.choice(DICTIONARY).capitalize() + r.choice(["", "&", "!", "#", "@", "_"]) + pick(string.digits, r.randint(1, 4)) + r.choice(["", "!", "?", "&", "*"]) + pick(alnum, r.randint(2, 6))
                value, before, after = value, left + name + join + quote, quote + right
            elif kind == 10:  # letters alone
                value, before, after = pick(string.ascii_letters, r.randint(16, 40)), left + name + join + quote, quote + right
            elif kind == 11:
                value = r.choice(["eyJ", "eyJ", "SG.", "M"]) + ".".join(pick(alnum + "_-", r.randint(16, 60)) for _ in range(r.choice([2, 3])))
                before, after = left + r.choice(["", "Bearer ", name + join + quote]), right
            elif r.random() < 0.5:
                title = r.choice(["RSA ", "EC ", "OPENSSH ", ""]) + "PRIVATE KEY"
                value, before, after = f"-----BEGIN {title}-----\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(r.randint(2, 20))) + f"\n-----END {title}-----", left, right
            else:
                value, before, after = pick(alnum + "!#&*", r.randint(8, 20)), left + r.choice(["postgres", "https", "amqp", "redis"]) + "://" + pick(string.ascii_lowercase, 5) + ":", "@" + r.choice(DICTIONARY) + ".com " + right
            out.append((value, before, after, path, 1))
            continue
        kind = r.randrange(16)
        before, after = left, right
        if kind == 0:
            value, before = pick(hexa, 40), left + r.choice(["commit ", "sha1 ", "revision ", "commit: ", ""])
        elif kind == 1:
            value, before = pick(hexa, r.choice([32, 64])), left + r.choice(["md5 ", "checksum=", "sha256 ", "digest: ", "etag=", ""])
        elif kind == 2:
            value, before = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), left + r.choice(["uuid ", "id=", "guid: ", "session ", ""])
        elif kind == 3:
            value = "".join(r.choice(DICTIONARY).capitalize() for _ in range(r.randint(3, 5))) + pick(string.digits, r.randint(1, 3))
        elif kind == 4:
            value, before = "/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + pick(string.digits, 2), left + r.choice(["http", "href=\"", "path ", ""])
        elif kind == 5:
            value = pick(string.digits, r.choice([16, 16, 18, 20, 24]))
        elif kind == 6:
            value, before = r.choice(["x", "0", "1", "a", "abc123", "changeme1", "password1"]) * 24, left + r.choice(["password=", "token = \"", "api_key: ", ""])
            value = value[: r.randint(16, 32)] + "1"
        elif kind == 7:
            value = f"20{pick(string.digits, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}_{word.lower()}-{pick(string.digits, 4)}"
        elif kind == 8:
            value = pick(string.ascii_lowercase, r.randint(12, 20)) + pick(string.digits, r.randint(2, 4))
            value = value if len(value) >= MIN_LENGTH else value * 2
        elif kind > 9:
            named = left + r.choice(["password", "token", "secret", "api key", "key", "the key", "auth", "Bearer", "credentials"])
            words = r.choice([DICTIONARY, [pick(string.ascii_lowercase, k) for k in (4, 5, 7, 9, 11)]])
            if kind == 10:  # prose after a credential word
                value, before = r.choice(words), named + r.choice([" ", " ", " is ", ": ", " was "])
            elif kind == 11:
                value, before = r.choice(["${%s}", "os.environ[%s]", "<%s>", "{{%s}}", "get_%s()", "config.%s", "your_%s_here", "changeme_%s", "%s_example", "$%s"]) % r.choice(words), named + r.choice(["=", " = ", ": "]) + r.choice(["", quote])
            elif kind == 12:  # long words, and words joined
                value = r.choice(["-", "_", "/", ""]).join(r.choice(words) for _ in range(4))
                value = r.choice([str, str.upper, str.title])(value if len(value) >= MIN_LENGTH else value + r.choice(["-", ""]) + value)
            elif kind == 13:
                value = ".".join(r.choice(words) + r.choice(["", "", "2"]) for _ in range(r.randint(3, 5)))
            elif kind == 14:  # short runs without a credential word
                value = r.choice([f"20{pick(string.digits, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T", word.lower() + pick(string.digits, 4), pick(hexa, 8), pick(alnum, 10), word + "-v" + pick(string.digits, 2)])
            elif r.random() < 0.4:
                value = "-----BEGIN CERTIFICATE-----\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(r.randint(2, 20))) + "\n-----END CERTIFICATE-----"
            else:  # quoted prose
                value, before, after = " ".join(r.choice(words) for _ in range(r.randint(2, 8))), named + r.choice(["=", ": "]) + '"', '"' + right
            out.append((value, before, after, path, 0))
            continue
        else:
            value, before = "_".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 5))) + "_" + pick(string.digits, 2), left + r.choice(["", "see ", "token = ", "key: "])
        if len(value) < MIN_LENGTH:
            value += "-" + value
        out.append((value, before, after, path, 0))
    return out


class Forest:
    """Trees grown on bootstrap samples by the Gini index, each split over a random share of the features."""

    def __init__(self, trees: int = 30, depth: int = 9, seed: int = 7):
        self.n, self.depth, self.seed, self.trees = trees, depth, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        draw = np.random.default_rng(self.seed)
        for _ in range(self.n):
            rows = draw.integers(0, len(x), len(x))
            nodes: list[list] = []
            self._grow(x[rows], y[rows], self.depth, draw, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, draw: np.random.Generator, nodes: list) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, float(y.mean())])
        if depth == 0 or len(y) < 4 or y.min() == y.max():
            return at
        best = (0.0, -1, 0.0)
        whole = 2 * y.mean() * (1 - y.mean())
        for f in draw.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5) + 1), replace=False):
            column = x[:, f]
            for cut in np.unique(np.quantile(column, np.linspace(0.05, 0.95, 12))):
                left = column <= cut
                n = left.sum()
                if 0 < n < len(y):
                    p, q = y[left].mean(), y[~left].mean()
                    gain = whole - (n * 2 * p * (1 - p) + (len(y) - n) * 2 * q * (1 - q)) / len(y)
                    if gain > best[0] + 1e-12:
                        best = (gain, int(f), float(cut))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            nodes[at][0], nodes[at][1] = best[1], best[2]
            nodes[at][2] = self._grow(x[left], y[left], depth - 1, draw, nodes)
            nodes[at][3] = self._grow(x[~left], y[~left], depth - 1, draw, nodes)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, share in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, np.where(x[rows, f] <= cut[node], left[node], right[node]))
            total += share[node]
        return total / max(1, len(self.trees))


def train(findings: DataFrame | None = None, max_findings: int = 20_000) -> Forest:
    """findings: value, before, after, path, label; without, labelled_findings()."""
    rows = labelled_findings() if findings is None else [tuple(r) for r in findings.select("value", "before", "after", "path", "label").limit(max_findings).collect()]
    return Forest().fit(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float))


def find(texts: list[str | None], paths: list[str | None], forest: Forest, least: float = 0.5) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each text the number of candidates, and the spans that are secrets."""
    spans = [candidates(t) if t else [] for t in texts]
    rows = [features(t[s:e], t[max(0, s - CONTEXT) : s], t[e : e + CONTEXT], p) for t, p, own in zip(texts, paths, spans, strict=True) for s, e in own]
    score = iter(forest.predict(np.array(rows)) if rows else ())
    return [(len(own), _joined([x for x in own if next(score) >= least])) for own in spans]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    out, upto = [], 0
    for s, e in spans:
        out += [text[upto:s], MARK]
        upto = e
    return "".join([*out, text[upto:]])


def scan(docs: DataFrame, forest: Forest, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_candidates, n_secrets, spans (start and end in code points), redacted_sha256 (of the text with MARK for each secret)."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, 1024) for b in batches for s in range(0, b.num_rows, 1024)):
            texts = batch.column(1).to_pylist()
            found = find(texts, batch.column(2).to_pylist(), shared.value)
            digests = [hashlib.sha256(redact(t or "", s).encode()).hexdigest() for t, (_, s) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for _, s in found], span), pa.array(digests, pa.string())],
                [key, "n_candidates", "n_secrets", "spans", "redacted_sha256"],
            )

    return mapped(docs.select(key, text, path), run, f"`{key}` {kind}, n_candidates bigint, n_secrets bigint, spans array<struct<start:bigint,end:bigint>>, redacted_sha256 string")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), train())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents; secrets in their texts are replaced by MARK, and n_chars follows."""
    shared = spark.sparkContext.broadcast(train())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, by = names.index("text"), names.index("source")
        for batch in (b.slice(s, 1024) for b in batches for s in range(0, b.num_rows, 1024)):
            texts = batch.column(at).to_pylist()
            found = find(texts, batch.column(by).to_pylist(), shared.value)
            new = [redact(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = batch.column(k).to_pylist()
                columns[k] = pa.array([len(n) if s else o for n, o, (_, s) in zip(new, old, found, strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(docs, run, docs.schema)
