"""Secret scans: three regular kinds, and sliding-window entropy over candidate strings, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

_CASES = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
KEYS = "|".join(map(_CASES, ("password", "passwd", "secret", "token"))) + "|" + _CASES("api") + "_?" + _CASES("key")
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""({KEYS})["']?\x20*[:=]\x20*["']?({VALUE}+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, each with the alphabet that is counted and the bits of entropy a window must reach.
CLASSES = {"hex": ("0123456789abcdef", 3.2), "alnum": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.6)}
#: Candidates that are no secrets: UUIDs, strings without a digit or without a letter, paths and dashed words, placeholders that end in
#: x's or in a word with EXAMPLE, digests named as such. Each is judged to the candidate's end, so a key behind such a part is found.
ALLOWED = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[^0-9]*$|^[^A-Za-z]*$|^[A-Za-z]+[0-9]{0,4}([/_=+-]+[A-Za-z]*[0-9]{0,4})*$|^[xX/_=+-]*$|[xX]{8,}$|(EXAMPLE|example)[A-Za-z0-9]*$|(^|[/_=+-])sha(1|256|512)[-=][A-Za-z0-9+/]*=*$"
UNIT = 1 << 16
_STEP = 128


def _log_table(window: int) -> Column:
    """c * log2(c) in integer units, so that the running sum is exact."""
    return F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0) for c in range(window + 1)])


def _let(value: Column, use) -> Column:
    """use(value), with value computed once though a lambda of use may read it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans (start, kind, stop) of the matches, in code points; keep: of a match, whether it stays.

    Lengths of what stands between the matches and of the matches themselves give the starts; they are summed in two
    levels, so the work follows the number of matches and not its square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(found, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"))), lambda x: x["m"].isNotNull())
    none = F.array().cast("array<struct<start:bigint,kind:string,stop:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<m:string,start:bigint>>").alias("at"))
    base = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<bigint>").alias("offsets"))

    def grow(acc, x):
        begin = acc["end"] + x["gap"]
        return F.struct((begin + F.length(x["m"])).alias("end"), F.concat(acc["at"], F.array(F.struct(x["m"].alias("m"), begin.alias("start")))).alias("at"))

    def place(local):
        offsets = F.aggregate(local, base, lambda acc, p: F.struct((acc["end"] + p["end"]).alias("end"), F.concat(acc["offsets"], F.array(acc["end"])).alias("offsets")), lambda acc: acc["offsets"])
        placed = F.flatten(F.zip_with(local, offsets, lambda p, o: F.transform(p["at"], lambda x: F.struct((x["start"] + o).alias("start"), (x["start"] + o + F.length(x["m"])).alias("stop"), x["m"].alias("m")))))
        placed = placed if keep is None else F.filter(placed, lambda x: keep(x["m"]))
        return F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop")))

    def solve(both):
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(both) / _STEP).cast("int") - 1), lambda k: F.slice(both, k * _STEP + 1, _STEP))
        return F.when(F.size(both) > 0, _let(F.transform(parts, lambda p: F.aggregate(p, start, grow)), place)).otherwise(none)

    return _let(pairs, solve)


def _entropic(word: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """Whether a window of `window` characters, all of the class, reaches so many bits.

    Characters enter and leave one at a time: each step changes two counts and the running sum of c log2 c. A character
    of another class empties the window. Entropy is log2(window) - sum / window.
    """
    n, table = len(alphabet), _log_table(window)
    most = math.floor((math.log2(window) - bits) * window * UNIT)
    places = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.position(F.substr(word, i, F.lit(1)), F.lit(alphabet)))
    start = lambda places: F.struct(F.array_repeat(F.lit(0), n).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("length"), F.lit(0).alias("i"), F.lit(False).alias("hit"), places.alias("places"))

    def step(acc, at):
        i = acc["i"] + 1
        gone = F.when((acc["length"] >= window) & (at > 0), F.element_at(acc["places"], i - window)).otherwise(F.lit(0))
        before_out = F.when(gone > 0, F.element_at(acc["counts"], gone)).otherwise(F.lit(0))
        less = F.when(gone > 0, F.transform(acc["counts"], lambda c, j: F.when(j == gone - 1, c - 1).otherwise(c))).otherwise(acc["counts"])
        sum_out = acc["sum"] + F.when(gone > 0, F.element_at(table, before_out) - F.element_at(table, before_out + 1)).otherwise(F.lit(0))
        before_in = F.when(at > 0, F.element_at(less, at)).otherwise(F.lit(0))
        more = F.when(at > 0, F.transform(less, lambda c, j: F.when(j == at - 1, c + 1).otherwise(c))).otherwise(F.array_repeat(F.lit(0), n))
        total = F.when(at > 0, sum_out + F.element_at(table, before_in + 2) - F.element_at(table, before_in + 1)).otherwise(F.lit(0)).cast("long")
        length = F.when(at > 0, F.least(acc["length"] + 1, F.lit(window))).otherwise(F.lit(0))
        return F.struct(more.alias("counts"), total.alias("sum"), length.alias("length"), i.alias("i"), (acc["hit"] | ((length == window) & (total <= most))).alias("hit"), acc["places"].alias("places"))

    return _let(places, lambda p: F.aggregate(p, start(p), step, lambda acc: acc["hit"]))


def spans(text: Column) -> dict[str, Column]:
    """Spans (start, kind, stop) of a text by kind; assign, access and hex are the base, entropy is the method's own."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    secret = lambda m: ~F.rlike(m, F.lit(ALLOWED)) & (_entropic(m, *CLASSES["hex"]) | _entropic(m, *CLASSES["alnum"]))
    none = F.array().cast("array<struct<start:bigint,kind:string,stop:bigint>>")
    when = lambda test, value: F.when(test, value).otherwise(none)
    return {
        "assign": when(F.rlike(text, F.lit(rf"({KEYS})[\"']?\x20*[:=]")), _spans(text, ASSIGN, "assign", long_value)),
        "access": when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access")),
        "hex": when(F.rlike(text, F.lit(HEX)), _spans(text, HEX, "hex")),
        "entropy": when(F.rlike(text, F.lit(CANDIDATE)), _spans(text, CANDIDATE, "entropy", secret)),
    }


_RANK = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}


def _joined(found: Column) -> Column:
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["kind"].alias("kind"), x["stop"].alias("stop"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points by start, then kind. Null and empty texts have none (the digest is that of an
    empty string). Each row stands alone: repeated rows and null ids are returned as they are, an empty table gives none.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in spans(F.col("text")).items()))
    base = F.concat("assign", "access", "hex")
    count = lambda c: F.size(c).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, "entropy")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each span of `text` replaced by mark; overlapping spans are one. Null texts stay null, all other columns stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.withColumn("__spans", F.concat(*spans(F.col("text")).values()))
    ordered = F.array_sort("__spans")
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("parts"))

    def step(acc, x):
        fresh = x["start"] >= acc["end"]
        piece = F.concat(F.substr(text, (acc["end"] + 1).cast("int"), (x["start"] - acc["end"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["end"], x["stop"]).alias("end"), F.when(fresh, F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"]).alias("parts"))

    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, (acc["end"] + 1).cast("int"), F.length(text))))
    return found.withColumn("text", F.when(F.size("__spans") > 0, clean).otherwise(F.col("text"))).select(docs.columns)
