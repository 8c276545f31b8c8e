"""Secret scans: base patterns, and a randomness test battery on other long runs.

A run of token characters that no base span covers is taken as hex, base 32,
base 36 or base 64 by the characters it has; '=' is padding at its end, and cuts
runs elsewhere (NAME=value). A run with signs is also tested without the plain
words at its ends, and each part between slashes by itself, so that a path
round a token doesn't hide it. Three tests on it:
  * chi-squared: are the alphabet's characters uniform? (two alphabets at most
    as long as the run allows: neighbouring characters are pooled to expect 2
    or more each),
  * runs: does the number of changes between kinds of characters (small letter,
    capital, digit, sign) fit a random string?
  * serial correlation of neighbouring characters.
A run is a secret if it fits a random string in all three (each p >= ALPHA) and
isn't text. Text is a chain of characters: kinds follow each other as in prose,
names in camel case, constants and paths; letters follow letters as in common
words. How much likelier the encoding makes the run than this chain is a test of
text: its inverse is a p value, whatever the length. These p values, weighted by
length, go through the step-up rule of false-discovery control over all runs of
the document.

Null and empty texts have no spans. Rows are scanned by themselves, so null and
repeated ids, ties and extra columns change nothing. Places are code points,
ends exclusive.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark as S

_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?")
#: Signs between the parts of a run, and parts that are a plain word or number.
SIGNS = re.compile(r"[+/_-]")
PLAIN = re.compile(r"[A-Z]?[a-z]*|[A-Z]+|[0-9]{1,8}")
#: Fewest characters of a run.
LEAST = 20
_HINT = re.compile(rf"{_NAMES}")
KINDS = ("assign", "access", "hex")

#: A run that fits a random string less well than this in any test is none.
ALPHA = 0.001
#: Share of false secrets among the runs taken as such.
DISCOVERY = 0.01
#: In text, the kind of the next character by that of one: small letter, capital, digit, sign, capital after a capital.
NEXT_KIND = ((0.85, 0.07, 0.04, 0.04), (0.60, 0.30, 0.05, 0.05), (0.15, 0.10, 0.60, 0.15), (0.55, 0.20, 0.20, 0.05), (0.06, 0.84, 0.05, 0.05))
#: Words whose letters, and pairs of them, stand for those of text: common ones, and those that long names are made of.
WORDS = """
the of and to in is that it for was on are as with his they be at one have this from or had by but some what there we can out
other were all your when up use word how said an each she which do their time if will way about many then them would write like
so these her long make thing see him two has look more day could go come did my sound no most number who over know water than
call first people may down side been now find any new work part take get place made live where after back little only round man
year came show every good me give our under name very through just form great think say help low line before turn cause same mean
differ move right boy old too does tell sentence set three want air well also play small end put home read hand port large spell
add even land here must big high such follow act why ask men change went light kind off need house picture try us again animal
class file user data string value list index object service server client request response message error handler factory builder
manager controller provider config option default version test case type node path source target local public static version key
der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch werden aus hat dass sie nach wird bei einer
le la les des est et une dans qui que pour pas sur plus par avec son elle nous vous mais ont cette
el los las una por con para como esta pero sus entre cuando todo tiene desde nos durante estados
"""
#: Weights of letter pairs, of letters, and of all letters alike, in what follows a letter.
PAIRS, LETTERS = 0.75, 0.20
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base32", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"),
)


def _tail(x: float, df: int) -> float:
    """P(chi-squared with df >= x), by the cube-root normal approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _letter_model() -> list[list[float]]:
    """Bits (log2 of the chance) of each letter of a-z after each, and at the start of a word (row 26)."""
    pairs, single, first = [[0.0] * 26 for _ in range(26)], [0.0] * 26, [0.0] * 26
    for word in WORDS.split():
        codes = [ord(c) - 97 for c in word]
        first[codes[0]] += 1
        for c in codes:
            single[c] += 1
        for a, b in itertools.pairwise(codes):
            pairs[a][b] += 1
    share = [x / sum(single) for x in single]
    mixed = [[PAIRS * x / max(sum(row), 1) + LETTERS * y + (1 - LETTERS - PAIRS * (sum(row) > 0)) / 26 for x, y in zip(row, share, strict=True)] for row in [*pairs, first]]
    return [[math.log2(x) for x in row] for row in mixed]


_LETTER = _letter_model()
_KIND = [[math.log2(x) for x in row] for row in NEXT_KIND]
_DIGIT, _SIGN = -math.log2(10), -math.log2(4)


def text_p(body: str, size: int) -> float:
    """The p value of text, from how much likelier a random string over `size` characters is than text to go on as body does after its first."""
    kinds = [_kind(c) for c in body]
    letters = [ord(c) - 97 for c in body.lower()]
    bits = 0.0
    for i in range(1, len(body)):
        k, before = kinds[i], kinds[i - 1]
        # a capital after a small letter begins a word
        after = 26 if before > 1 or before == 0 and k == 1 else letters[i - 1]
        row = 4 if before == 1 and i > 1 and kinds[i - 2] == 1 else before
        bits += _KIND[row][k] + (_LETTER[after][letters[i]] if k < 2 else _DIGIT if k == 2 else _SIGN)
    return 2.0 ** min(0.0, max(-1000.0, bits + (len(body) - 1) * math.log2(size)))


def battery(run: str) -> tuple[str, float, float, float, float] | None:
    """The encoding, p of uniformity, of runs and of serial correlation for a random string, and p for text; None: no encoding fits."""
    body = run.rstrip("=")
    found = next(((name, a) for name, a in ENCODINGS if not set(body) - set(a)), None)
    if found is None or len(body) < 16:
        return None
    name, alphabet = found
    if name == "base64":
        alphabet = alphabet[:64]
    n, places = len(body), {c: i for i, c in enumerate(alphabet)} | ({"_": 63, "-": 62} if name == "base64" else {})
    values = [places[c] for c in body]
    bins = max(2, min(len(alphabet), n // 2))
    counts = [0] * bins
    for v in values:
        counts[v * bins // len(alphabet)] += 1
    sizes = [0] * bins
    for i in range(len(alphabet)):
        sizes[i * bins // len(alphabet)] += 1
    chi = sum((c - n * s / len(alphabet)) ** 2 / (n * s / len(alphabet)) for c, s in zip(counts, sizes, strict=True))
    shares = [0, 0, 0, 0]
    for c in alphabet:
        shares[_kind(c)] += 1 / len(alphabet)
    change = 1 - sum(s * s for s in shares)
    changes = sum(_kind(a) != _kind(b) for a, b in zip(body, body[1:]))  # noqa: B905
    runs = _two_sided((changes - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change)))
    mean = (len(alphabet) - 1) / 2
    spread = (len(alphabet) ** 2 - 1) / 12
    serial = _two_sided(sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])) / spread / math.sqrt(n - 1))  # noqa: B905
    return name, _tail(max(chi, 1e-9), bins - 1), runs, serial, text_p(body, len(alphabet))


def pieces(start: int, run: str) -> list[tuple[int, int, str]]:
    """The run, what is left of it without plain words at its ends, and each of its parts between slashes: those that are long enough."""
    cuts = [(m.start(), m.end()) for m in SIGNS.finditer(run)]
    spans = {(0, len(run))}
    if cuts:
        parts = list(zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(run)], strict=True))
        odd = [p for p in parts if not PLAIN.fullmatch(run, *p)]
        if odd:
            spans.add((odd[0][0], odd[-1][1]))
        slashes = [s for s, _ in cuts if run[s] == "/"]
        spans.update(zip([0, *(s + 1 for s in slashes)], [*slashes, len(run)], strict=True))
    return [(start + s, start + e, run[s:e]) for s, e in sorted(spans) if e - s >= LEAST]


def apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of spans (start, end, kind) that overlap, the longest."""
    out: list[tuple[int, int, str]] = []
    for x in sorted(spans):
        if out and x[0] < out[-1][1]:
            out[-1] = max(out[-1], x, key=lambda y: y[1] - y[0])
        else:
            out.append(x)
    return out


def clear_of(runs: list[tuple[int, int, str]], spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The runs that overlap none of the spans, which are in order of their starts."""
    starts = [s for s, _, _ in spans]
    reach = [0, *itertools.accumulate((e for _, e, _ in spans), max)]
    return [r for r in sorted(runs) if reach[bisect.bisect_left(starts, r[1])] <= r[0]]


def random_runs(runs: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of (start, end, run), those that are taken as secrets, each with its encoding."""
    tested = [(s, e, b) for s, e, r in runs if (b := battery(r))]
    if not tested:
        return []
    # weights that grow with length, 1 on average: short runs need smaller p values
    mean = sum(e - s for s, e, _ in tested) / len(tested)
    ranked = sorted((b[4] * mean / (e - s), s, e, b) for s, e, b in tested)
    last = max((i for i, x in enumerate(ranked, 1) if x[0] <= DISCOVERY * i / len(ranked)), default=0)
    return apart([(s, e, f"random_{b[0]}") for _, s, e, b in ranked[:last] if min(b[1:4]) >= ALPHA])


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a whole text: base ones, and random runs outside of them."""
    base = []
    if _HINT.search(text):
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = []
    if max(map(len, text.split()), default=0) >= 20:
        base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        runs = [x for m in RUN.finditer(text) for x in pieces(m.start(), m[0])]
    base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return sorted(base + random_runs(clear_of(runs, base)), key=lambda x: (x[0], KINDS.index(x[2]) if x[2] in KINDS else len(KINDS), x[2]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str) -> str:
    """The text with each secret (overlapping spans as one) replaced by a mark that names its kind."""
    out, at = [], 0
    for s, e, kind in scan(text):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, end, kind), one row per row of docs."""

    def run(batches):
        for b in S.slices(batches):
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))], ["doc_id", "spans"])

    S.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("spans array<struct<start: long, end: long, kind: string>>").fields]))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced, and n_chars (if there) as the text then has; null stays null."""
    at = docs.columns.index("text")

    def run(batches):
        for b in S.slices(batches):
            columns = b.columns
            columns[at] = pa.array([None if t is None else redact(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    S.small_batches(docs.sparkSession)
    numbered = S.numbered(docs)
    out = numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(S.table(spark, sf_dir, "documents"))
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    counts = {f"n_{k}": F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)") for k in KINDS}
    base = "filter(spans, x -> x.kind in ('assign', 'access', 'hex'))"
    return found.select("doc_id", *(c.alias(k) for k, c in counts.items()), F.sha2(F.expr(text.format(base)), 256).alias("base_sha256"), F.expr(text.format("spans")).alias("spans"))

