"""Secret scans by a randomness test battery. DataFrame and SQL functions only.

Base spans come from three patterns. Besides, every run of LEAST token letters or more is a candidate: its encoding is inferred from the
letters it holds. A run that fits no alphabet is split at / and +, at - and _, and at all four; each long piece that fits one is a
candidate. Digits alone are none, as written numbers are no less random. Two things are asked of a candidate:
- Randomness: chi-squared against a uniform alphabet, runs about the alphabet's middle, lag-1 serial correlation, on the letters'
  indices in the alphabet. A random string passes all three; one that a test rejects at GATE is no secret.
- That it isn't written: its likelihood as a uniform draw from its alphabet against that under a model of written names and words (kinds of
  letters by the kind before, letters by their share in language, cases that seldom change). The inverse of that ratio, times the number of
  alphabets tried, is a p-value for "this is written", whatever the alphabet and length: under the model the ratio exceeds c at 1/c at most.
False discoveries are controlled at FDR by Benjamini-Hochberg within each band of encoding and length. The p-values are
counted in fixed bins, so the step-up rule needs a table of bounded size and no sort of all candidates; a bin counts with its upper
edge, which keeps the rule on the safe side.

Match positions are the lengths of what `split` leaves between the matches and of the matches themselves, in code points.
Defined cases: a null or empty text has no span; repeated rows are scanned each; other columns stay; overlapping kinds are all listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import cut, text_or_empty

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LONG = ASSIGN[:-2] + "{12,})"
ACCESS = "AKIA[A-Z0-9]{14,}"  # the run is taken whole, so this equals dropping runs under 18
HEX = "[0-9a-f]{16,}"
#: Letters of a candidate at least.
LEAST = 16
CANDIDATE = f"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
KINDS = ("assign", "access", "hex", "random")
FDR, GATE = 0.01, 0.001
#: Alphabets in their usual order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "upperhex": "0123456789ABCDEF",
    "lower32": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "letters64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "letters64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_",
}
#: Pieces of a run that fits no alphabet.
PIECES = tuple(f"[A-Za-z0-9{more}]{{{LEAST},}}={{0,2}}" for more in ("_-", "+/", ""))
#: Shares of the letters a to z in written language, in per mille (mean of English, French, German and Spanish).
SHARES = (85, 16, 32, 45, 140, 14, 19, 30, 68, 4, 6, 45, 28, 76, 61, 19, 6, 66, 74, 68, 40, 12, 11, 2, 8, 5)
#: The model of written names: a letter's kind (vowel, consonant, digit, mark) by the kind before it, the last row for the first letter;
#: this part of the letters comes evenly; the first letter after none is lower-case, and the next one keeps the case, with these chances.
KINDS_AFTER = ((0.13, 0.82, 0.02, 0.03), (0.50, 0.43, 0.03, 0.04), (0.06, 0.12, 0.72, 0.10), (0.25, 0.55, 0.15, 0.05), (0.20, 0.45, 0.30, 0.05))
EVEN, LOWER_FIRST, SAME_CASE = 0.1, 0.6, 0.95
MARKS = "+/_-"
#: The upper tail of the normal distribution (Abramowitz and Stegun 26.2.17).
_TAIL = (0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429))
#: Bins of -log10(p), and their number.
BIN, BINS = 0.05, 800
_SPAN = "array<struct<start: bigint, end: bigint, kind: int, text: string, value: string>>"


def _spans(pattern: str, needed: str, kind: int, value: int, least: int, text: str = "_text") -> str:
    """SQL for the spans of the leftmost matches that don't overlap, in order, of those whose group `value` has `least` letters."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found, groups, between = f"regexp_extract_all({text}, {q(pattern)}, 0)", f"regexp_extract_all({text}, {q(pattern)}, {value})", f"split({text}, {q(pattern)}, -1)"
    rows = f"arrays_zip({found}, {groups}, transform(slice({between}, 1, greatest(size({found}), 1)), p -> length(p)))"
    walk = f"""aggregate(filter({rows}, x -> x.`0` is not null), named_struct('at', 0L, 'out', cast(array() as {_SPAN})),
        (acc, x) -> named_struct('at', acc.at + x.`2` + length(x.`0`), 'out', if(length(x.`1`) < {least}, acc.out, concat(acc.out, array(
            named_struct('start', acc.at + x.`2`, 'end', acc.at + x.`2` + length(x.`0`), 'kind', {kind}, 'text', x.`0`, 'value', x.`1`))))),
        acc -> acc.out)"""
    return f"if(rlike({text}, {q(needed)}), {walk}, cast(array() as {_SPAN}))"


def _upper(z: str) -> str:
    """P(N > z), for z of any sign."""
    c, b = _TAIL
    poly = "0D"
    for x in reversed(b):
        poly = f"(({x}D + {poly}) * (1 / (1 + {c}D * abs({z}))))"
    tail = f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327D * {poly})"
    return f"if({z} >= 0, {tail}, 1 - {tail})"


def _bind(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _encoding(s: str) -> str:
    """SQL for the alphabet that a run fits, null if none."""
    both = f"rlike({s}, '[a-z]') and rlike({s}, '[A-Z]')"
    rules = [("^[0-9]+$", "", None), ("^[0-9a-f]+$", f"rlike({s}, '[0-9]')", "hex"), ("^[0-9A-F]+$", f"rlike({s}, '[0-9]')", "upperhex")]
    rules += [("^[A-Z]+$", "", "upper"), ("^[a-z]+$", "", "lower"), ("^[A-Z2-7]+$", "", "base32"), ("^[a-z2-7]+$", "", "lower32"), ("^[A-Z0-9]+$", "", "base36"), ("^[a-z0-9]+$", "", "lower36")]
    rules += [("^[A-Za-z]+$", "", "letters"), ("^[A-Za-z+/]+$", both, "letters64"), ("^[A-Za-z_-]+$", both, "letters64url"), ("^[A-Za-z0-9+/]+$", both, "base64"), ("^[A-Za-z0-9_-]+$", both, "base64url")]
    return "case " + " ".join(f"when rlike({s}, '{p}')" + (f" and {more}" if more else "") + f" then {repr(k) if k else 'null'}" for p, more, k in rules) + " end"


def _candidates(runs: str = "_found") -> str:
    """SQL for the runs that fit an alphabet, and the pieces that do of those that don't."""
    fits = lambda x: f"({_encoding(f"rtrim('=', {x}.text)")}) is not null"
    pieces = "concat(" + ", ".join(_spans(p, p, 3, 0, LEAST, "r.text") for p in PIECES) + ")"
    moved = f"transform({pieces}, p -> named_struct('start', r.start + p.start, 'end', r.start + p.end, 'kind', p.kind, 'text', p.text, 'value', p.value))"
    return f"flatten(transform({runs}, r -> if({fits('r')}, array(r), array_distinct(filter({moved}, y -> {fits('y')})))))"


def model_tables() -> tuple[str, list[int], list[float], list[float], list[float]]:
    """The model's letters, the kind of each, the logarithm of its share in its kind, and those of the kinds and of the cases."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789" + MARKS
    kinds = [0 if c in "aeiou" else 1 if c.isalpha() else 2 if c.isdigit() else 3 for c in letters]
    shares = [(1 - EVEN) * SHARES[i] / sum(SHARES) + EVEN / 26 if i < 26 else 1.0 for i in range(len(letters))]
    of_kind = [sum(p for p, k in zip(shares, kinds, strict=True) if k == kind) for kind in range(4)]
    inside = [math.log(p / of_kind[k]) for p, k in zip(shares, kinds, strict=True)]
    return letters, kinds, inside, [math.log(p) for row in KINDS_AFTER for p in row], [math.log(x) for x in (SAME_CASE, 1 - SAME_CASE, LOWER_FIRST, 1 - LOWER_FIRST)]


def _written(s: str) -> str:
    """SQL for the logarithm of a run's likelihood as a written name."""
    letters, kinds, inside, after, cases = model_tables()
    same, change, low_first, high_first = cases
    numbers = lambda x, kind: "array(" + ", ".join(f"{v!r}{kind}" for v in x) + ")"
    rows = f"""transform(split({s}, ''), x -> transform(array(instr('{letters}', lower(x)) - 1),
        i -> named_struct('k', get({numbers(kinds, "")}, i), 'p', get({numbers(inside, "D")}, i), 'u', if(i >= 26, 2, if(x = lower(x), 0, 1))))[0])"""
    case = f"if(x.u = 2, 0D, if(a.u = 2, if(x.u = 0, {low_first!r}D, {high_first!r}D), if(a.u = x.u, {same!r}D, {change!r}D)))"
    return f"""aggregate({rows}, named_struct('l', 0D, 'k', 4, 'u', 2),
        (a, x) -> named_struct('l', a.l + get({numbers(after, "D")}, a.k * 4 + x.k) + x.p + {case}, 'k', x.k, 'u', x.u), a -> a.l)"""


def _tested(candidate: str = "c") -> str:
    """SQL for the battery's verdict on one candidate: a struct of encoding, band, bin and whether the gates are passed."""
    s = f"rtrim('=', {candidate}.text)"
    letters = "case " + " ".join(f"when e.encoding = '{k}' then '{v}'" for k, v in ALPHABETS.items()) + " end"
    sums = """aggregate(e.v, named_struct('n', 0D, 's', 0D, 'ss', 0D, 'sp', 0D, 'high', 0D, 'runs', 0D, 'prev', cast(null as int)),
        (a, x) -> named_struct('n', a.n + 1, 's', a.s + x, 'ss', a.ss + x * x, 'sp', a.sp + coalesce(a.prev * x, 0), 'high', a.high + if(2 * x >= e.k, 1, 0),
            'runs', a.runs + if(a.prev is null or (2 * x >= e.k) <> (2 * a.prev >= e.k), 1, 0), 'prev', x))"""
    squares = "aggregate(split(e.letters, ''), 0D, (a, x) -> a + power(length(e.s) - length(replace(e.s, x, '')), 2))"
    chi = "(e.k * f.sq / f.n - f.n - (e.k - 1)) / sqrt(2 * (e.k - 1) * (1 - 1 / f.n))"
    low = "(f.n - f.high)"
    mean_runs = f"(1 + 2 * f.high * {low} / f.n)"
    var_runs = f"((2 * f.high * {low} * (2 * f.high * {low} - f.n)) / (f.n * f.n * (f.n - 1)))"
    runs = f"if({var_runs} > 0, abs(f.runs - {mean_runs}) / sqrt({var_runs}), 99D)"
    var = "(f.ss / f.n - f.s * f.s / f.n / f.n)"
    serial = f"if({var} > 0, abs((f.sp / (f.n - 1) - f.s * f.s / f.n / f.n) / {var}) * sqrt(f.n), 99D)"
    # -log10 of the p-value
    less = f"(-f.n * ln(e.k) - {math.log(len(ALPHABETS))!r}D - {_written('e.s')}) / ln(10D)"
    verdict = f"""named_struct('encoding', e.encoding, 'band', concat(e.encoding, ':', cast(floor(log2(f.n) * 2) as string)),
        'bin', cast(least(greatest(floor({less} / {BIN}D), 0), {BINS - 1}) as int),
        'gate', {_upper("g.chi")} >= {GATE}D and 2 * {_upper("g.runs")} >= {GATE}D and 2 * {_upper("g.serial")} >= {GATE}D)"""
    verdict = _bind(f"named_struct('chi', {chi}, 'runs', {runs}, 'serial', {serial})", "g", verdict)
    with_sums = _bind(sums, "a", _bind(f"named_struct('n', a.n, 's', a.s, 'ss', a.ss, 'sp', a.sp, 'high', a.high, 'runs', a.runs, 'sq', {squares})", "f", verdict))
    indices = _bind("named_struct('encoding', e.encoding, 's', s, 'letters', e.letters, 'k', length(e.letters), 'v', transform(split(s, ''), x -> instr(e.letters, x) - 1))", "e", with_sums)
    with_letters = _bind(f"named_struct('encoding', e.encoding, 'letters', {letters})", "e", indices)
    return _bind(s, "s", _bind(f"named_struct('encoding', {_encoding('s')})", "e", f"if(e.encoding is null, null, {with_letters})"))


def scan(docs: DataFrame) -> DataFrame:
    """`docs` with base (spans of the three patterns) and tested (candidates that have an encoding, with band, bin and gate)."""
    base = F.concat(*(F.expr(_spans(*x)) for x in ((ASSIGN, ASSIGN_LONG, 0, 2, 12), (ACCESS, ACCESS, 1, 0, 18), (HEX, HEX, 2, 0, 16))))
    out = docs.withColumn("_text", text_or_empty()).withColumn("base", base).withColumn("_found", F.expr(_spans(CANDIDATE, CANDIDATE, 3, 0, LEAST)))
    out = out.withColumn("_found", F.expr(_candidates()))
    out = out.withColumn("base", F.expr("array_sort(transform(base, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end)))"))
    tested = f"filter(transform(_found, c -> named_struct('start', c.start, 'end', c.end, 'test', {_tested()})), c -> c.test is not null)"
    return out.withColumn("tested", F.expr(tested)).drop("_text", "_found")


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """The least bin that counts as a discovery, for each band that has one. Bands are bounded: encodings times half-powers of two."""
    counts = scanned.select(F.inline("tested")).select("test.*").groupBy("band", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("band")
    up = F.sum("n").over(w.orderBy(F.desc("bin")))
    edge = F.pow(F.lit(10.0), -F.col("bin") * BIN)
    m = F.sum("n").over(w)
    ok = counts.withColumn("up", up).withColumn("m", m).where(edge <= F.lit(fdr) * F.col("up") / F.col("m"))
    return {r["band"]: r["least"] for r in ok.groupBy("band").agg(F.min("bin").alias("least")).collect()}


def flag(scanned: DataFrame, least: dict[str, int]) -> DataFrame:
    """base, and secrets: base and the discoveries by start, then kind."""
    known = F.create_map(*[F.lit(x) for k, v in sorted(least.items()) for x in (k, v)]) if least else F.lit(None).cast("map<string,int>")
    more = F.transform(F.filter("tested", lambda c: c["test"]["gate"] & (c["test"]["bin"] >= F.coalesce(known[c["test"]["band"]], F.lit(BINS)))), lambda c: F.struct(c["start"], F.lit(3).alias("kind"), c["end"]))
    return scanned.withColumn("secrets", F.array_sort(F.concat("base", more))).drop("tested")


def find_secrets(docs: DataFrame, fdr: float = FDR, written: bool = False) -> DataFrame:
    """`docs` with base and secrets: arrays of start, kind (index in KINDS) and end, in code points.

    written: the scanned rows are written once and read by both steps; else the texts are scanned once for each.
    """
    plain = [c for c in docs.columns if c not in {"base", "tested", "secrets"}]
    scanned = scan(docs.select(*plain))
    if written:
        scanned = cut(scanned.drop("text"))
    return flag(scanned, thresholds(scanned, fdr))


def joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def redact(found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The texts with each secret's span (overlapping ones together) replaced by `mark`; columns base and secrets go."""
    text = f"""aggregate(secrets, named_struct('at', 0L, 'out', ''),
        (acc, x) -> if(x.end <= acc.at, acc, named_struct('at', x.end, 'out',
            if(x.start < acc.at, acc.out, concat(acc.out, substring(text, cast(acc.at + 1 as int), cast(x.start - acc.at as int)), '{mark}')))),
        acc -> concat(acc.out, substring(text, cast(acc.at + 1 as int))))"""
    return found.withColumn("text", F.expr(f"if(size(secrets) > 0, {text}, text)")).drop("base", "secrets")
