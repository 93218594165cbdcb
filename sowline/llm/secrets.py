"""Secret scans in DataFrame functions only.

Base kinds are fixed patterns.  The method's kind, ``markov``, takes what the
base spans leave of the maximal runs of ``[A-Za-z0-9+/_=-]``, in parts of 20 or
more characters, and compares two character Markov models (first order, one
table of transitions each): one of random strings, one of ordinary
identifiers.  A part is a secret if the log-likelihood ratio of its transitions
is at least ``MARKOV_MIN`` nats a transition on average.

The random model is the even mixture of uniformly random strings over the
alphabets of ``RANDOM``.  The ordinary model is trained on ``ordinary_runs``, a
fixed sample of identifiers with digits, and on the corpus's own long runs of
letters, underscores and hyphens, which weigh at most as much as the sample.
Both tables are brought to the same total and smoothed alike.  ``MARKOV_MIN``
lies between held-out random strings and held-out identifiers (see the tests).

Spans are (kind, start, end) in code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sowline.llm.common import unused

# The base patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16

KINDS = ("assign", "access", "hex", "markov")
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"^[A-Za-z_-]+$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
UPPER, LOWER, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
# Alphabets of random strings: base62, base64, base64url, base36 in both
# cases, hex in both cases.
RANDOM = (UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "_-",
          UPPER + DIGITS, LOWER + DIGITS, "ABCDEF" + DIGITS, "abcdef" + DIGITS)
# Words of ordinary_runs.
WORDS = """account address algorithm analysis application archive argument attribute authorization balance benchmark binary
boundary buffer builder calculate callback category certificate channel checkpoint classification client cluster collection
column command compile component compress configure connect constant container content context controller convert counter
create customer dashboard database decode default delete dependency deployment describe destination device dictionary
directory discount document download dynamic element employee enable encrypt endpoint engine environment error evaluate
event example exception execute export expression factory feature field filter folder format framework frequency function
generate graph group hardware header height hierarchy history identifier image implementation import index information
initialize input instance integration interface invoice iterator journal kernel keyboard language latency launch layout
library license limit listener location logger machine manifest mapping maximum measure memory message method middleware
minimum module monitor network normalize notification number object operation optimize option order output package
parameter parse partition password path payment performance permission pipeline platform plugin policy position prefix
primary priority private process product profile project property protocol provider public publish quality quantity query
queue record reference region register release remote render repository request require reset resolve resource result
retry return revision route runtime sample schedule schema search section security select sequence server service session
setting shipping signature snapshot source specification standard status storage stream string structure subscribe summary
support switch symbol syntax system table target template terminal thread threshold timeout timestamp token tracking
transaction transform translate trigger tutorial unique update upload utility validate value variable vector verify version
view virtual volume warehouse weather website weight widget window workflow wrapper year zone geschwindigkeit verarbeitung
gesellschaft einstellungen nachrichten wissenschaft versicherung ergebnisse entwicklung actualites developpement bibliotheque
gouvernement utilisateur evenement connaissance recherche informacion configuracion desarrollo administracion direccion
usuarios noticias historia resultado""".split()
SHORTS = "ACL API ASCII AWS CPU CSS CSV DB DNS FTP GPU GUID HTML HTTP HTTPS ID IO IP JSON JVM JWT OS PDF RAM REST RPC SDK SQL SSH TCP TLS UDP UI URI URL USB UTF UUID VM XML YAML".split()
TOTAL = 20_000.0        # transitions of each model's table
PRIOR = 1.0             # added to every character's count
PULL = 5.0              # weight, in transitions, of the characters' own rates
MARKOV_MIN = 0.5        # nats a transition
RUN_MIN = 20
MASK = "[SECRET]"

SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches whose ``group`` has
    ``least`` or more characters.  The texts between the matches give the
    positions."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("gap"))
    placed = F.aggregate(
        rows, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r["gap"]) + F.coalesce(F.length(r["m"]), F.lit(0))).alias("at"),
            F.when(F.length(r["v"]) >= least, F.array_append(acc["out"], F.struct(
                F.lit(kind).alias("kind"), (acc["at"] + F.length(r["gap"])).alias("start"),
                (acc["at"] + F.length(r["gap"]) + F.length(r["m"])).alias("end"), r["v"].alias("value"))))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), placed).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds in kind order.  A run shorter than its
    least length is no candidate to begin with for access and hex, whose
    matches are maximal runs: the same as dropping it afterwards."""
    return F.concat(_spans(text, ASSIGN, 0, 2, ASSIGN_MIN),
                    _spans(text, ACCESS.replace("+", f"{{{ACCESS_MIN - 4},}}"), 1),
                    _spans(text, HEX.replace("+", f"{{{HEX_MIN},}}"), 2))


def _outside(run: Column, base: Column) -> Column:
    """The parts of ``run`` that no base span covers, of RUN_MIN or more characters."""
    def add(acc: Column, end: Column) -> Column:
        return F.when(end - acc["at"] >= RUN_MIN, F.array_append(acc["out"], F.struct(
            run["kind"].alias("kind"), acc["at"].alias("start"), end.alias("end"),
            F.substring(run["value"], acc["at"] - run["start"] + 1, end - acc["at"]).alias("value")))).otherwise(acc["out"])

    inside = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    order = F.array_sort(F.transform(inside, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    return F.aggregate(
        order, F.struct(run["start"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), add(acc, b["start"]).alias("out")),
        lambda acc: add(acc, run["end"]))


def scanned(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` plus a column of base spans and one of candidate runs outside
    them (names in the second value).  NULL and empty texts have neither."""
    names = {k: unused(docs, f"secret_{k}") for k in ("base", "runs")}
    t = F.coalesce(F.col(text), F.lit(""))
    base, runs = F.col(names["base"]), F.col(names["runs"])
    out = docs.withColumn(names["base"], base_spans(t)).withColumn(names["runs"], _spans(t, RUN, 3))
    return out.withColumn(names["runs"], F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(
        F.flatten(F.transform(runs, lambda r: _outside(r, base))))), names


def ordinary_runs() -> list[str]:
    """The fixed sample of ordinary runs: words joined in the usual ways, with
    abbreviations, numbers, dates, versions and rules of one character."""
    n, out, shorts = len(WORDS), [], len(SHORTS)
    for i, a in enumerate(WORDS):
        b, c = WORDS[(7 * i + 3) % n], WORDS[(11 * i + 5) % n]
        year, day = f"{1990 + i % 40}", f"{1 + i % 12:02d}-{1 + i * 7 % 28:02d}"
        short, other = SHORTS[i % shorts], SHORTS[(5 * i + 2) % shorts]
        number, long = f"{i * 37 % 1000}", f"{(i + 1) * 7919 % 10 ** 10:010d}"
        out += [f"{a}_{b}_{c}", f"{a}-{b}-{c}", f"{a}/{b}/{c}", f"{a}{b.title()}{c.title()}", f"{a.title()}{b.title()}{c.title()}",
                f"{a}_{b}_{c}".upper(), f"{a}-{b}-{c}".title(), f"{a}{b}{c}", f"{a}_{b}{number}_{c}", f"{a}-{number}-{b}-{c}",
                f"/{a}/{year}/{day.replace('-', '/')}/{b}-{c}", f"{a}_{year}-{day}_{number}", f"{year}-{day}-{a}-{b}", f"{long}-{long[::-1]}-{number}",
                f"{a}{number}{b.title()}{i % 10}", f"{a}={number}-{b}={c}", f"{a}--{b}__{c}==", f"{a.title()}{number}/{b.upper()}_{number}", f"{a}+{b}+{c}",
                f"{short}{a.title()}{other}{b.title()}", f"{a}{short}{b.title()}{other}{number}", f"{a}V{i % 10}{b.title()}{number}", f"{short}_{a.upper()}_{other}{i % 10}"]
    return out + [c * 40 for c in "-_=/+"] + ["-=" * 20, "0123456789" * 4, "1234567890" * 4]


def train(docs: DataFrame, text: str = "text") -> list[float]:
    """Log-likelihood ratio of every transition (row-major over ALPHABET).

    Counts are summed before they meet; what comes to the driver has at most
    ``len(ALPHABET) ** 2`` rows.
    """
    found, names = scanned(docs, text)
    words = F.transform(F.filter(names["runs"], lambda s: s["value"].rlike(ORDINARY)), lambda s: s["value"])
    pairs = found.select(F.explode(words).alias("value")).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.col("value").substr(i, F.lit(2)))).alias("pair"))
    n = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    own, fixed, random = ([[0.0] * n for _ in range(n)] for _ in range(3))
    for r in pairs.groupBy("pair").count().collect():
        own[place[r.pair[0]]][place[r.pair[1]]] += r["count"]
    for run in ordinary_runs():
        for a, b in zip(run, run[1:]):
            fixed[place[a]][place[b]] += 1
    for letters in RANDOM:
        for a in letters:
            for b in letters:
                random[place[a]][place[b]] += 1 / len(letters) ** 2
    total = lambda seen: sum(map(sum, seen))
    share = min(1.0, total(fixed) / max(1.0, total(own)))
    ordinary = [[f + share * o for f, o in zip(*rows)] for rows in zip(fixed, own)]

    def log_chances(seen: list[list[float]]) -> list[float]:
        """Transitions drawn towards how often the second character comes at all."""
        scale = TOTAL / total(seen)
        seen = [[x * scale for x in row] for row in seen]
        ends = [sum(row[j] for row in seen) + PRIOR for j in range(n)]
        return [math.log((seen[i][j] + PULL * ends[j] / sum(ends)) / (sum(seen[i]) + PULL)) for i in range(n) for j in range(n)]

    return [a - b for a, b in zip(log_chances(random), log_chances(ordinary))]


def find(docs: DataFrame, model: list[float] | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus a column with all spans by start, then kind (its name is
    the second value).  ``model`` is that of ``train`` (trained on ``docs`` if
    not given)."""
    model = train(docs, text) if model is None else model
    found, names = scanned(docs, text)
    n = len(ALPHABET)
    # one literal array, folded by the optimizer
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")

    def ratio(value: Column) -> Column:
        place = lambda i: F.call_function("instr", F.lit(ALPHABET), value.substr(i, F.lit(1))) - 1
        return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0),
                           lambda acc, i: acc + F.get(table, place(i) * n + place(i + 1)))

    secret = F.filter(names["runs"], lambda r: ratio(r["value"]) >= MARKOV_MIN * (F.length(r["value"]) - 1))
    spans = unused(docs, "secret_spans")
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    out = found.withColumn(spans, F.array_sort(F.transform(F.concat(F.col(names["base"]), secret), bare)))
    return out.drop(*names.values()), spans


def as_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by MASK (overlapping spans
    by one) and ``n_chars``, where there is one, set to the new length of the
    texts that changed.  Other columns and texts are unchanged."""
    found, name = find(docs, model)
    spans, t = F.col(name), F.col("text")
    masked = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], t.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)))
            .otherwise(acc["out"]).alias("out"))),
        lambda acc: F.concat(acc["out"], t.substr(acc["at"] + 1, F.length(t))))
    hit = F.size(spans) > 0
    out = found.withColumn("text", F.when(hit, masked).otherwise(t))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
