"""Personal data: candidate spans scored by gradient-boosted trees, with DataFrame functions only.

Base rules (email, ip, card, phone) always count. Broad generators then propose further, overlapping spans (spelled-out
addresses, numbers without a plus, identity numbers, account numbers, keys); small boosted trees score each from its
format and its context, and those over their kind's calibrated threshold are added where they meet no accepted span.
The trees are fitted on the driver on a generated, labelled set of fixed size, and become SQL expressions, so the main
path stays in the JVM.

Places of matches come from the texts between them: split() and regexp_extract_all() with one pattern give the gaps
and the hits in turn, and running sums of their lengths, made by doubling, give places in code points and in bytes.
Pieces of a text are cut from its bytes, so no step walks a text again for each of its matches. Patterns start only where a run of
their characters starts, or where the last match ended, and are possessive, so that long runs cost linear time and no
stack.

Defined results: a null text is empty and has no spans; kinds are searched independently, so base spans of different
kinds may overlap; rows are judged by themselves, whatever their doc_id; an empty table gives an empty result; other
columns are kept away.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import read
from quirelake.llm.line_rules import let

# Patterns of the base kinds, each as stated, with a start guard and possessive loops.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of further candidates: kind, pattern, a character that any match holds.
MORE = {
    "email": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[a-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?|\.)[a-z]{2,}+(?![a-z])", "@([a"),
    "phone": (r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9-]|\.[0-9])", "0"),
    "identity": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "0"),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "0"),
    "key": (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+(?![A-Za-z0-9_-])", "0"),
}
KINDS = ("email", "ip", "card", "phone", "identity", "account", "key")
BEFORE = 40
CHECKED = 64  # a check digit is looked for in so many digits at most
FEATURES = ("length", "digits", "letters_capital", "letters_small", "breaks", "cue_contact", "cue_secret", "cue_number", "hex_only", "distinct", "lead_zero", "check_digit")
CUES = {"cue_contact": "phone|tel|call|mail|contact|fax|reach", "cue_secret": "key|token|secret|password|bearer|api|auth", "cue_number": "ssn|social|identity|iban|account|no\\.|number|passport"}


def scanned(a: Column, join) -> Column:
    """Running totals of an array under an associative join, by doubling: size * log(size) steps."""
    rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length(F.bin(F.greatest(F.lit(0), F.size(a) - 1).cast("long"))) - 1))

    def double(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.coalesce(join(x, F.get(acc, i - back)), x))

    return F.aggregate(rounds, a, double)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, low, high, hit>> of all matches in order; start and end in code points, low and high in
    bytes."""
    size = lambda x: F.char_length(x).cast("long") + F.octet_length(x).cast("long") * F.lit(1 << 32)  # noqa: E731  both sums in one number

    def placed(parts: Column) -> Column:
        steps = F.zip_with(F.slice(parts["gaps"], F.lit(1), F.size(parts["hits"])), parts["hits"], lambda g, h: size(g) + size(h))

        def one(end: Column, h: Column) -> Column:
            start, places = end - size(h), {}
            for name, x, part in (("start", start, 0), ("end", end, 0), ("low", start, 1), ("high", end, 1)):
                places[name] = (F.shiftright(x, 32) if part else x.bitwiseAND(F.lit((1 << 32) - 1))).cast("int")
            return F.struct(*(v.alias(k) for k, v in places.items()), h.alias("hit"))

        return F.zip_with(scanned(steps, lambda x, y: x + y), parts["hits"], one)

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), placed)


def piece(raw: Column, low: Column, high: Column) -> Column:
    """Bytes [low, high) of a binary value as text, in time of their own number."""
    return F.substring(raw, low + 1, high - low).cast("string")


def apart(candidates: Column, taken: Column) -> Column:
    """The candidates that meet no span of `taken`."""
    event = lambda own: lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["low"].alias("low"), s["high"].alias("high"), s["hit"].alias("hit"))
    events = F.array_sort(F.concat(F.transform(taken, event(0)), F.transform(candidates, event(1))))
    ends = lambda e: scanned(F.transform(e, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(0)), F.greatest)
    nexts = lambda e: F.reverse(scanned(F.transform(F.reverse(e), lambda x: F.when(x["own"] == 0, x["start"]).otherwise((1 << 31) - 1)), F.least))

    def kept(v: Column) -> Column:
        free = F.filter(v["e"], lambda x, i: (x["own"] == 1) & (F.get(v["ends"], i) <= x["start"]) & (F.get(v["nexts"], i) >= x["end"]))
        return F.transform(free, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "end", "low", "high", "hit"))))

    met = let(events, lambda e: let(F.struct(e.alias("e"), ends(e).alias("ends"), nexts(e).alias("nexts")), kept))
    return F.when((F.size(candidates) == 0) | (F.size(taken) == 0), candidates).otherwise(met)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]++", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    place = lambda i: F.substring(d, F.char_length(d) - i, 1).cast("int")
    term = lambda i: F.when(i % 2 == 0, place(i)).otherwise(F.when(place(i) > 4, 2 * place(i) - 9).otherwise(2 * place(i)))
    return F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


CHECKS = {
    "email": lambda h: F.lit(True),
    "ip": lambda h: F.forall(F.split(h, r"\."), lambda p: F.regexp_like(p, F.lit("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))),
    "card": lambda h: let(digits(h), lambda d: F.char_length(d).between(16, 19) & luhn(F.when(F.char_length(d).between(16, 19), d).otherwise("0"))),
    "phone": lambda h: F.char_length(digits(h)).between(8, 15),
}
HAS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
NONE = "array<struct<start:int,end:int,low:int,high:int,hit:string>>"


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(spans(text, BASE[kind]), lambda s: CHECKS[kind](s["hit"]))
    there = F.contains(text, F.lit("@")) if kind == "email" else F.regexp_like(text, F.lit(HAS[kind]))
    return F.when(there, found).otherwise(F.array().cast(NONE))


# Boosted trees


def _features(kind: str, hit: str, before: str) -> list[float]:
    """As feature_columns(), of one labelled example."""
    import re

    d = re.sub("[^0-9]", "", hit)
    total = sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(int(c) for c in reversed(d))) if 0 < len(d) <= CHECKED else 1
    cue = {k: float(bool(re.search(v, before.lower()))) for k, v in CUES.items()}
    return [len(hit), len(d), len(re.sub("[^A-Z]", "", hit)), len(re.sub("[^a-z]", "", hit)), len(re.sub("[^ .()-]", "", hit)), cue["cue_contact"], cue["cue_secret"], cue["cue_number"], float(bool(re.fullmatch("[0-9a-f]+", hit))), len(set(hit)), float(d[:1] == "0"), float(total % 10 == 0)]


def feature_columns(hit: Column, before: Column) -> dict[str, Column]:
    low, d = F.lower(before), digits(hit)
    size = lambda drop: F.char_length(F.regexp_replace(hit, drop, "")).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out = [F.char_length(hit).cast("double"), F.char_length(d).cast("double"), size("[^A-Z]"), size("[^a-z]"), size("[^ .()-]")]
    out += [flag(F.regexp_like(low, F.lit(v))) for v in CUES.values()]
    out += [flag(F.regexp_like(hit, F.lit("^[0-9a-f]+$"))), F.size(F.array_distinct(F.split(hit, ""))).cast("double"), flag(F.substring(d, 1, 1) == "0"), flag(luhn(F.when(F.char_length(d).between(1, CHECKED), d).otherwise("1")))]
    return dict(zip(FEATURES, out, strict=True))


def generated(kind: str, rng: np.random.Generator, n: int) -> tuple[list[list[float]], list[int]]:
    """A labelled set for one kind: the generator's matches in made-up contexts."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda abc, k: "".join(pick(abc) for _ in range(k))
    lower, upper, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: chars(lower, int(rng.integers(2, 9)))
    plain = ["", "the ", "of them ", "and so on, ", "in the year "]
    x, y = [], []
    for _ in range(n):
        good = bool(rng.random() < 0.5)
        if kind == "email":
            hit = f"{word()}{pick(['', '.' + word()])} (at) {word()} (dot) {pick(['com', 'org', 'net', 'de'])}" if good else f"{word()} (at) {word()}.{word()}"
            before = pick(["mail me: ", "contact ", "write to "]) if good or rng.random() < 0.2 else pick(plain)
        elif kind == "phone":
            sep = pick(" -.")
            hit = f"({chars('23456789', 1)}{chars(dig, 2)}){sep}{chars(dig, 3)}{sep}{chars(dig, 4)}" if good and rng.random() < 0.6 else f"{chars(dig, 3)}{sep}{chars(dig, 3 + int(rng.integers(2)))}{sep}{chars(dig, 4)}"
            before = pick(["call ", "tel. ", "phone: ", "fax "]) if good else pick([*plain, "number "])
        elif kind == "identity":
            hit = f"{chars(dig, 3)}-{chars(dig, 2)}-{chars(dig, 4)}"
            before = pick(["ssn ", "social security number ", "identity no. "]) if good else pick(plain)
        elif kind == "account":
            hit = f"{chars(upper, 2)}{chars(dig, 2)} " + " ".join(chars(dig, 4) for _ in range(4)) if good else f"{chars(upper, 2)}{chars(dig, 2)}" + "".join(chars(upper, 4) for _ in range(4))
            before = pick(["iban ", "account: ", ""]) if good else pick(plain)
        else:
            k = int(rng.integers(24, 65)) if rng.random() < 0.7 else int(rng.integers(65, 400))
            hit = (chars("0123456789abcdef", pick([32, 40, 64, k])) if rng.random() < 0.5 else chars(lower + upper + dig, k)) if good else pick([chars(lower, k), "-" * k, "_" * k, chars("ab", k), "-".join(word() for _ in range(8))[:k].ljust(24, "a")])
            before = pick(["api_key = ", "token = ", "secret: ", "password ", ""]) if good else pick(plain)
        x.append(_features(kind, hit, before))
        y.append(int(good))
    return x, y


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 12, rate: float = 0.4, bins: int = 16) -> list[tuple]:
    """Trees of depth two for the logistic loss: (feature, cut, left subtree, right subtree) with leaf values."""
    margin, trees = np.zeros(len(y)), []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        best, base = (1e-9, None, None), g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[rows, f], np.linspace(0, 1, bins)[:-1])):
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                if len(left) and len(right):
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - base
                    if gain > best[0]:
                        best = (gain, f, float(cut))
        return best

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        _, f, cut = split(rows, g, h) if depth else (0, None, None)
        if f is None:
            value = float(-rate * g[rows].sum() / (h[rows].sum() + 1))
            margin[rows] += value
            return round(value, 6)
        return f, cut, grow(rows[x[rows, f] <= cut], g, h, depth - 1), grow(rows[x[rows, f] > cut], g, h, depth - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), 2))
    return trees


def score(trees: list, x: list[float]) -> float:
    def leaf(t):
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        return t

    return sum(map(leaf, trees))


@lru_cache(maxsize=1)
def models() -> dict[str, tuple[list, float]]:
    """(trees, threshold) of each further kind; the threshold is the least with a precision of 0.98 on held-out rows."""
    out = {}
    for k, kind in enumerate(MORE):
        rng = np.random.default_rng(100 + k)
        x, y = generated(kind, rng, 900)
        trees = boosted(np.array(x[:600]), np.array(y[:600]))
        held = sorted(((score(trees, a), b) for a, b in zip(x[600:], y[600:], strict=True)), reverse=True)
        right = np.cumsum([b for _, b in held]) / np.arange(1, len(held) + 1)
        ok = np.flatnonzero(right >= 0.98)
        out[kind] = trees, max(0.0, held[int(ok[-1])][0] if len(ok) else 9.0)
    return out


def tree_column(tree, features: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(features[FEATURES[f]] <= F.lit(cut), tree_column(low, features)).otherwise(tree_column(high, features))


def more_spans(text: Column, raw: Column, kind: str, taken: Column) -> Column:
    """Candidates of a kind over its threshold that meet no span of `taken`. raw: the text's bytes."""
    trees, threshold = models()[kind]
    pattern, hint = MORE[kind]

    def passes(s: Column) -> Column:
        before = F.right(piece(raw, F.greatest(F.lit(0), s["low"] - 4 * BEFORE), s["low"]), F.lit(BEFORE))
        names = list(FEATURES)
        features = F.struct(*(v.alias(k) for k, v in feature_columns(s["hit"], before).items()))
        margin = let(features, lambda f: reduce(lambda a, b: a + b, (tree_column(t, {n: f[n] for n in names}) for t in trees)))
        return margin >= threshold

    there = F.regexp_like(text, F.lit("[\\[(] ?[aA][tT] ?[\\])]")) if hint != "0" else F.regexp_like(text, F.lit("[0-9]" if kind != "key" else "[A-Za-z0-9_-]{24}"))
    passing = let(F.filter(spans(text, pattern), passes), lambda c: apart(c, taken))
    return F.when(there, passing).otherwise(F.array().cast(NONE))


def found(docs: DataFrame) -> DataFrame:
    """docs with columns _base (a struct of base spans by kind), _more_KIND (added spans), _text and _raw."""
    docs = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = F.struct(*(base_spans(F.col("_text"), k).alias(k) for k in BASE))
    docs = docs.withColumn("_base", base)
    taken = F.concat(*(F.col(f"_base.{k}") for k in BASE))

    docs = docs.withColumn("_raw", F.col("_text").cast("binary"))
    for k in MORE:  # kind by kind, as the spans of one are taken for the next
        docs = docs.withColumn(f"_more_{k}", more_spans(F.col("_text"), F.col("_raw"), k, taken))
        taken = F.concat(taken, F.col(f"_more_{k}"))
    return docs


def _named(kind: str, array: Column) -> Column:
    return F.transform(array, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def _all_of(kind: str) -> Column:
    parts = ([F.col(f"_base.{kind}")] if kind in BASE else []) + ([F.col(f"_more_{kind}")] if kind in MORE else [])
    return F.array_sort(F.concat(*parts)) if len(parts) > 1 else parts[0]


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans; one row per row of docs (doc_id, text)."""
    d = found(docs.select("doc_id", "text"))
    base = F.concat(*(_named(k, F.col(f"_base.{k}")) for k in BASE))
    every = F.concat(*(_named(k, _all_of(k)) for k in KINDS))
    return d.select("doc_id", *(F.size(f"_base.{k}").cast("long").alias(f"n_{k}") for k in BASE), F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", every).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by the kind of the widest span there, as <EMAIL>; other columns stay."""
    own = F.struct(*(F.col(f"`{n}`") for n in docs.columns))  # apart from columns made here
    d = found(docs.select(own.alias("_row"), "text"))

    def labelled(kind: str) -> Column:
        return F.transform(_all_of(kind), lambda s: F.struct(s["low"].alias("low"), (-s["high"]).alias("high"), F.lit(f"<{kind.upper()}>").alias("label")))

    def replaced(v: Column) -> Column:
        """Where a span begins behind all before it, the text between and a label; then the rest."""
        end = lambda i: F.coalesce(F.get(v["ends"], i - 1), F.lit(0))
        fresh = F.filter(F.transform(v["o"], lambda s, i: F.struct(end(i).alias("from"), s["low"].alias("low"), s["label"].alias("label"))), lambda s: s["from"] <= s["low"])
        parts = F.transform(fresh, lambda s: F.concat(piece(F.col("_raw"), s["from"], s["low"]), s["label"]))
        return F.concat(F.array_join(parts, ""), piece(F.col("_raw"), F.element_at(v["ends"], -1), F.octet_length("_raw")))

    ordered = F.array_sort(F.concat(*map(labelled, KINDS)))
    ends = lambda o: scanned(F.transform(o, lambda s: -s["high"]), F.greatest)
    new = let(ordered, lambda o: F.when(F.size(o) == 0, F.col("_text")).otherwise(let(F.struct(o.alias("o"), ends(o).alias("ends")), replaced)))
    new = F.when(F.col("text").isNotNull(), new)
    return d.select(*((new if n == "text" else F.col("_row").getField(n)).alias(n) for n in docs.columns))


def op9_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(read(spark, sf_dir, "documents"))


QUERIES = {"op9_boosted_pii": op9_boosted_pii}
ORACLE_SQL: dict[str, str] = {}
