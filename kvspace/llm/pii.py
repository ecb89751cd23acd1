"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose spans that may overlap. The base kinds (email, ip, card,
phone) are checked by their formats and always stay. The other kinds are judged by boosted
trees over format and context features; the trees are compiled into a column expression,
and a span counts when its probability reaches its kind's threshold.

No table marks personal data. The trees learn from planted cases: random values of many
forms, personal data and look-alikes of each kind (order numbers, versions, digests, file
names, long words, settings, code), are put into the middle of a bounded sample of the
corpus' own texts, and the generators' candidates there carry the form's label. The
thresholds are set on texts that the trees have not seen, for each kind the least
probability from which on the precision holds.

Null texts count as empty. Very long texts are handled whole; all patterns are linear, and
the runs of keys, secrets and handles have no upper length (numbers have the lengths of their
formats). Ties between overlapping spans go to the longer one, then to the kind listed first.
Repeated rows give repeated results. An empty table gives an empty result. Other columns,
whatever their names, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspace.llm.store import cut
from kvspace.llm.text import unused
from kvspace.llm.trees import Node, tree_column, tree_of

#: Texts whose pieces the planted cases are put into, at most, and cases of each form without a text around them.
CONTEXTS, BARE = 160, 16
ROUNDS, DEPTH = 8, 4
#: The precision that a kind's threshold must reach on the texts held out, and the least threshold.
PRECISION, LEAST = 0.97, 0.3

#: Items of an array that are scanned at a time.
BLOCK = 64
_MARK = "￿"
_LOCAL = "A-Za-z0-9._%+-"

#: Patterns of the base kinds. Each is the contract's pattern with possessive runs, and a start
#: that skips places inside a run where the run's own start has failed already.
BASE = {
    "email": f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of the kinds that the trees judge.
GENERATED = {
    "key": "(?<![A-Za-z0-9])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9])",
    "secret": "(?i:password|passwd|pwd|secret|token|api_?key|access_?key|auth)[\"']?\\s{0,3}+[:=]\\s{0,3}+[\"']?[^\\s\"',;]{4,}+",
    "handle": f"(?i)(?<![{_LOCAL}])[a-z0-9._+-]{{2,}}+ ?[\\[({{] ?at ?[\\])}}] ?[a-z0-9-]{{2,}}+ ?(?:[\\[({{] ?dot ?[\\])}}]|\\.) ?[a-z]{{2,}}+",
    "number": "(?<![0-9A-Za-z.+-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![0-9A-Za-z])",
}
KINDS = (*BASE, *GENERATED)
FEATURES = ("length", "digits", "capitals", "smalls", "marks", "variety", "turns", "mixed", "hint", "other", "quoted", "after_equals", "vendor", "domain", "plain", "country", "generator")

# Cues before a value, forms of values, and endings.
_HINT = "(?i)(key|token|secret|passw|auth|bearer|credential|mail|phone|tel|call|fax|mobile|ssn|iban|account|contact)[^A-Za-z]*$"
_OTHER = "(?i)(?<![a-z])(order|invoice|ref|version|section|part|serial|model|commit|sha-?[0-9]*|md5|digest|hash|checksum|uuid|isbn|no|page|fig|size|file|path|id|bytes|tracking|build)[.:#=]*\\s*[\"']?$"
_VENDOR = "^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-|eyJ)"
_DOMAIN = "(?i)(?:com|org|net|edu|gov|io|de|fr|es|it|uk|eu|info|biz|co|me|dev|app)$"
_COUNTRY = "^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}"
#: (kind, personal?, form). Greek letters stand for random signs, see _POOLS.
FORMS = (
    ("key", 1, "AKIAκκκκκκκκκκκκκκκκ"), ("key", 1, "ghp_" + "μ" * 36), ("key", 1, "sk-" + "μ" * 32), ("key", 1, "sk-" + "λ" * 24), ("key", 1, "xoxb-" + "δ" * 11 + "-" + "μ" * 24), ("key", 1, "Bearer " + "β" * 44),
    ("key", 1, "η" * 32), ("key", 1, "η" * 40), ("key", 1, "η" * 64), ("key", 1, "η" * 300), ("key", 1, "μ" * 24), ("key", 1, "μ" * 40), ("key", 1, "β" * 64 + "=="), ("key", 1, "eyJ" + "β" * 120),
    ("key", 1, "my key is " + "μ" * 20), ("key", 1, "account key " + "κ" * 20), ("key", 1, "β" * 150), ("key", 1, "η" * 128),
    ("key", 0, "λ" * 16), ("key", 0, "λ" * 19), ("key", 0, "λ" * 24), ("key", 0, "υ" + "λ" * 20), ("key", 0, "λλλλλ_λλλλλλ_λλλλλλ"), ("key", 0, "λλλλ-λλλλλ-λλλ-λλλλλλ"), ("key", 0, "λλλλλλ/λλλλ/λλλλλλλλ"), ("key", 0, "λλλυλλλλλλυλλλλλυλλλ"),
    ("key", 0, "-" * 24), ("key", 0, "_" * 20), ("key", 0, "commit " + "η" * 40), ("key", 0, "sha256: " + "η" * 64), ("key", 0, "md5 " + "η" * 32), ("key", 0, "uuid ηηηηηηηη-ηηηη-ηηηη-ηηηη-ηηηηηηηηηηηη"), ("key", 0, "δδδδ-δδ-δδ-δδ-δδ-δδ"),
    ("key", 0, "order " + "δ" * 18), ("key", 0, "δ" * 17), ("key", 0, "isbn δδδ-δ-δδδδ-δδδδ-δ"), ("key", 0, "file λλλλλλλδδ_λλλλλλδδ"), ("key", 0, "λλλλλλλλλλλλλλδδ"), ("key", 0, "λλλλ/λλλδ/λλλλλλ/λλλλδδ"), ("key", 0, "λλλλλλλλ+λλλλλλλλ"),
    ("key", 0, "λ" * 33), ("key", 0, "λ" * 52), ("key", 0, "υ" + "λ" * 37), ("key", 0, "λλλ/λλλλ/λλλλλλλλλ/λλλλλλλλλ"), ("key", 0, "λλλυλλλλλλυλλλλλλλυλλλλλλλυλλλλλλλ"), ("key", 0, "λλλλλλλλλλλλλλλ_λλ_λλλλλλλ"), ("key", 0, "λλλλλλλλ-λλ-λλλ-λλλ-λλλλλλλλ-λλλλλ"), ("key", 0, "υλλλλλλλυλλλλλλλλυλλλλλλ"),
    ("secret", 1, 'token = "' + "η" * 40 + '"'), ("secret", 1, "password: μμμμμμμμμ"), ("secret", 1, "pwd=λλλλλδδ"), ("secret", 1, "secret = '" + "μ" * 24 + "'"), ("secret", 1, "api_key=" + "μ" * 32), ("secret", 1, "auth: " + "β" * 28),
    ("secret", 1, "passwd λλλ password=υλλλλδδ!"), ("secret", 1, "access_key: " + "κ" * 20), ("secret", 1, "token: " + "η" * 201), ("secret", 1, "password = λλλλ-λλλλ-δδδδ"), ("secret", 1, "secret: " + "β" * 600), ("secret", 1, "auth: sk-" + "λ" * 20),
    ("secret", 0, "password: required"), ("secret", 0, "token = null"), ("secret", 0, "secret: none"), ("secret", 0, "auth: basic"), ("secret", 0, "token: λλλλλ"), ("secret", 0, "password: λλλλλλλ"), ("secret", 0, "secret: λλλλλλλλλλ"), ("secret", 0, "auth = λλλλ"), ("secret", 0, "password: υλλλλλ"),
    ("secret", 0, "token: λλλλ.λλλλλ()"), ("secret", 0, "password = λλλλ(λλλ)"), ("secret", 0, "auth: λλλλλ-λλλλ"),
    ("handle", 1, "λλλλ.λλλλλ [at] λλλλλλ [dot] com"), ("handle", 1, "λλλλλδδ(at)λλλλλλ.org"), ("handle", 1, "λλλλλλ {at} λλλλλ {dot} net"), ("handle", 1, "λ.λλλλλλ [at] λλλλ.de"), ("handle", 1, "λλλλ_λλλ [at] λλλλλλλλ [dot] fr"), ("handle", 1, "λ" * 80 + " [at] " + "λ" * 60 + " [dot] io"),
    ("handle", 0, "λλλλ (at) λλλλ.λλλλλλ"), ("handle", 0, "λλλλλ [at] λλλ.next"), ("handle", 0, "fig (at) λλλλ.λλλλλ"), ("handle", 0, "λλλλλλ{at}λλλλλ.value"), ("handle", 0, "λλλλ [at] λλλλλ.λλλλλλλ"),
    ("number", 1, "SSN δδδ-δδ-δδδδ"), ("number", 1, "δδδ-δδ-δδδδ"), ("number", 1, "tel. (δδδ) δδδ-δδδδ"), ("number", 1, "(δδδ) δδδ-δδδδ"), ("number", 1, "+1 (δδδ) δδδ-δδδδ"), ("number", 1, "call δδδ-δδδ-δδδδ"), ("number", 1, "phone: δδδ.δδδ.δδδδ"), ("number", 1, "mobile δδδ δδδ δδδδ"),
    ("number", 1, "IBAN DEδδ" + "δ" * 18), ("number", 1, "FRδδ" + "δ" * 10 + "κ" * 11 + "δδ"), ("number", 1, "account GBδδυυυυ" + "δ" * 14), ("number", 1, "ESδδ" + "δ" * 20),
    ("number", 0, "order δδδ-δδ-δδδδ"), ("number", 0, "part δδδ-δδδ-δδδδ"), ("number", 0, "invoice no. δδδ-δδδ-δδδδ"), ("number", 0, "version δδδ.δδδ.δδδδ"), ("number", 0, "build δδδ.δδδ.δδδδ"), ("number", 0, "serial υυδδ" + "κ" * 14), ("number", 0, "model υυδδ" + "κ" * 12),
    ("number", 0, "ref. δδδ δδδ δδδδ"), ("number", 0, "size δδδ δδδ δδδδ"), ("number", 0, "tracking υυδδ" + "κ" * 13), ("number", 0, "no. δδδ-δδ-δδδδ"),
)
_POOLS = {"δ": "0123456789", "η": "0123456789abcdef", "λ": "abcdefghijklmnopqrstuvwxyz", "υ": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "κ": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "μ": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "β": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value computed once however often it is used: it is bound as a lambda's argument."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def scanned(items: Column, begin: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states (of type ``kind``) after each item, from the state ``begin`` on.

    An array that grows by one is copied each time, so items are scanned in blocks of BLOCK and
    only the blocks' arrays are gathered: the copying stays below a few dozen entries for each item.
    """
    none, blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, item: Column) -> Column:
        return once(step(acc["s"], item), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out")))

    def block(acc: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(items_, at * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["s"].alias("s"), none.alias("out")), one)
        return once(inner, lambda x: F.struct(x["s"].alias("s"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    items_: Column

    def all_of(bound: Column) -> Column:
        nonlocal items_
        items_ = bound
        many = F.sequence(F.lit(0), ((F.greatest(F.size(bound), F.lit(1)) - 1) / BLOCK).cast("int"))
        return F.flatten(F.aggregate(many, F.struct(begin.alias("s"), blocks.alias("out")), block)["out"])

    return once(items, all_of)


def spans_of(text: Column, pattern: str, context: int = 0) -> Column:
    """Array of (start, end, value, left): leftmost non-overlapping matches, code points, end exclusive.

    Matches are set off by a mark that no pattern matches; the lengths of the parts between
    marks give the positions.
    """
    parts = F.split(F.regexp_replace(text, F.lit(f"(?s){pattern}" if not pattern.startswith("(?") else pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)

    def step(acc: Column, part: Column) -> Column:  # every second part is a match; the one before it is its left side
        before = F.right(acc["value"], F.lit(context)) if context else F.lit("")
        return F.struct(acc["end"].alias("start"), (acc["end"] + F.char_length(part)).cast("int").alias("end"), part.alias("value"), before.alias("left"))

    begin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"), F.lit("").alias("left"))
    return F.filter(scanned(parts, begin, step, "struct<start:int,end:int,value:string,left:string>"), lambda s, i: i % 2 == 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    d = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return (total + twice).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(d), F.lit(1))), F.lit(0), add) % 10 == 0


_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$"),
    "card": lambda v: F.when(F.char_length(_digits(v)).between(13, 19), luhn(v)).otherwise(False),
    "phone": lambda v: F.char_length(_digits(v)).between(9, 15),
}


def _valid(kind: str):
    return lambda s: VALID[kind](s["value"])


def base_spans(text: Column) -> dict[str, Column]:
    """The valid matches of each base kind."""
    gate = {"email": "@", "ip": ".", "card": "", "phone": "+"}
    out = {}
    for kind, pattern in BASE.items():
        found = F.filter(spans_of(text, pattern), _valid(kind))
        none = F.array().cast("array<struct<start:int,end:int,value:string,left:string>>")
        out[kind] = F.when(F.contains(text, F.lit(gate[kind])), found).otherwise(none) if gate[kind] else found
    return out


def candidate_spans(text: Column) -> dict[str, Column]:
    return {kind: spans_of(text, pattern, 24) for kind, pattern in GENERATED.items()}


def features(kind: Column, value: Column, left: Column) -> list[Column]:
    n = F.greatest(F.char_length(value), F.lit(1)).cast("double")
    less = lambda pattern: (F.char_length(value) - F.char_length(F.regexp_replace(value, pattern, ""))) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    number = F.coalesce(*[F.when(kind == k, F.lit(float(i))) for i, k in enumerate(GENERATED)], F.lit(-1.0))
    turned = F.regexp_replace(value, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", "|")
    return [
        n, less("[0-9]"), less("[A-Z]"), less("[a-z]"), 1 - less("[A-Za-z0-9]"), F.size(F.array_distinct(F.split(value, ""))) / n,
        (F.char_length(turned) - n) / n, flag(value.rlike("[0-9]") & value.rlike("[A-Za-z]")), flag(left.rlike(_HINT)), flag(left.rlike(_OTHER)), flag(left.rlike("[\"']$")),
        flag(left.rlike("[=:]\\s*[\"']?$")), flag(value.rlike(_VENDOR)), flag(value.rlike(_DOMAIN)), flag(value.rlike("[:=]\\s*[\"']?[A-Za-z]?[a-z.()-]+$")), flag(value.rlike(_COUNTRY)), number,
    ]


def planted(seed: Column, form: Column) -> Column:
    """The form with its Greek letters replaced by signs that depend on the seed and their places."""

    def sign(c: Column, i: Column) -> Column:
        out = c
        for letter, pool in _POOLS.items():
            at = F.pmod(F.xxhash64(seed, form, i), F.lit(len(pool))) + 1
            out = F.when(c == letter, F.substring(F.lit(pool), at.cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(form, ""), sign), "")


def cases(docs: DataFrame, contexts: int = CONTEXTS, forms=FORMS) -> DataFrame:
    """(seed, kind, label, value, left, at): the generators' candidates that overlap a value planted in a text.

    Texts are the ``contexts`` of least hash, each once however often it is repeated, and BARE
    empty ones; 30 signs from each side of some place in them surround the value.
    """
    hashed = docs.select(F.xxhash64("text").alias("seed"), clean(F.col("text")).alias("t"))
    least = [r["seed"] for r in hashed.select("seed").distinct().orderBy("seed").limit(contexts).collect()]
    picked = hashed.filter(F.col("seed").isin(least)).groupBy("seed").agg(F.min("t").alias("t"))
    # the values alone, so that there are cases whatever the texts are
    bare = docs.sparkSession.range(BARE).select(F.col("id").alias("seed"), F.lit("").alias("t"))
    seeded = picked.unionByName(bare).select("t", "seed", F.pmod("seed", F.greatest(F.char_length("t") - 29, F.lit(1))).cast("int").alias("p"))
    made = F.array(*[F.struct(F.lit(k).alias("form_kind"), F.lit(float(y)).alias("label"), F.lit(f).alias("form")) for k, y, f in forms])
    rows = seeded.select("seed", F.substring("t", F.col("p") + 1, F.lit(30)).alias("before"), F.substring("t", F.col("p") + 31, F.lit(30)).alias("after"), F.explode(made).alias("m")).select("*", "m.*")
    filled = rows.select("seed", "label", F.char_length("before").alias("from"), F.concat("before", F.lit(" "), planted(F.col("seed"), F.col("form")), F.lit(" "), "after").alias("text"), F.char_length("form").alias("size"))
    found = filled.select("seed", "label", "from", "size", F.explode(F.concat(*[F.transform(spans, _named(k)) for k, spans in candidate_spans(F.col("text")).items()])).alias("c"))
    return found.filter((F.col("c.end") > F.col("from") + 1) & (F.col("c.start") <= F.col("from") + F.col("size"))).select("seed", "c.kind", "label", "c.value", "c.left")


class Detector:
    """Boosted trees and a threshold for each kind."""

    def __init__(self, trees: list[tuple[Node, float]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, vector: list[Column]) -> Column:
        total = F.lit(0.0)
        for node, weight in self.trees:
            total = total + tree_column(node, lambda i: vector[i]) * weight
        return 1 / (1 + F.exp(-2 * total))

    def chosen(self, spans: Column) -> Column:
        """The spans of the generated kinds that reach their kind's threshold; none of a detector without trees, which ``fit`` never gives.

        All kinds are judged in one pass, so that the trees stand in the plan once.
        """
        if not self.trees:
            return F.filter(spans, lambda s: F.lit(False))

        def passes(s: Column) -> Column:  # features are held in an array, so that each is computed once for a span
            vector = F.transform(F.array(F.array(*[f.cast("double") for f in features(s["kind"], s["value"], s["left"])])), lambda v: self.probability([F.get(v, F.lit(i)) for i in range(len(FEATURES))]))
            least = F.coalesce(*[F.when(s["kind"] == k, F.lit(p)) for k, p in self.thresholds.items()])
            return F.get(vector, F.lit(0)) >= least

        return F.filter(spans, passes)


def clean(text: Column) -> Column:
    """The text, empty for null, with the mark's own character swapped for one of equal length that no pattern matches."""
    return F.translate(F.coalesce(text, F.lit("")), _MARK, "￾")


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["left"].alias("left"))


def fit(docs: DataFrame, contexts: int = CONTEXTS) -> Detector:
    """A detector from cases planted in ``contexts`` of the texts at most: half of them for the trees, half for the thresholds."""
    known = cases(docs, contexts)
    vector = features(F.col("kind"), F.col("value"), F.col("left"))
    sample = cut(known.select("kind", "label", (F.pmod(F.xxhash64("seed"), F.lit(2)) == 0).alias("fit"), *[v.cast("double").alias(n) for v, n in zip(vector, FEATURES, strict=True)]).coalesce(1))  # some 20,000 rows
    half = F.col("fit")  # the bare cases fall on both sides
    both = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.filter(half))
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=4, seed=11).fit(both)
    trees = [(tree_of(tree), float(w)) for tree, w in zip(model.trees, model.treeWeights, strict=True)]
    detector = Detector(trees, {})
    held = sample.filter(~half)
    scored = held.select("kind", "label", detector.probability([F.col(n) for n in FEATURES]).alias("p"))
    grid = scored.groupBy("kind", F.floor(F.col("p") * 100).alias("g")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()  # 400 rows at most
    for kind in GENERATED:
        own = sorted(((r["g"], r["good"], r["n"]) for r in grid if r["kind"] == kind), reverse=True)
        best, good, n = 0.5, 0.0, 0
        for g, a, b in own:
            good, n = good + a, n + b
            if good / n >= PRECISION:
                best = max(g / 100, LEAST)
        detector.thresholds[kind] = best
    return detector


def with_spans(docs: DataFrame, detector: Detector, column: str = "_pii") -> DataFrame:
    """docs with a struct ``column`` of the spans of every kind, arrays of (start, end)."""
    bare = lambda s: F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    name, judged = unused(docs, "clean"), unused(docs, "judged")
    text = F.col(name)
    every = F.concat(*[F.transform(s, _named(k)) for k, s in candidate_spans(text).items()])
    # the kinds' arrays read the judged spans several times, so these are a column of their own
    named = docs.withColumn(name, clean(F.col("text"))).withColumn(judged, detector.chosen(every))
    columns = {k: bare(s) for k, s in base_spans(text).items()}
    columns |= {k: bare(F.filter(judged, _of_kind(k))) for k in GENERATED}
    return named.withColumn(column, F.struct(*[c.alias(k) for k, c in columns.items()])).drop(name, judged)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _written(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))


def _replaced(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(f"[{kind.upper()}]").alias("name"))


def _joined(struct: str, kinds) -> Column:
    return F.array_join(F.concat(*[F.transform(F.col(f"{struct}.{k}"), _written(k)) for k in kinds]), ",")


def report(docs: DataFrame) -> DataFrame:
    found = with_spans(docs.select("doc_id", "text"), fit(docs)).drop("text")
    return found.select(
        "doc_id",
        *[F.size(f"_pii.{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined("_pii", BASE), 256).alias("base_sha256"),
        _joined("_pii", KINDS).alias("spans"),
    )


def redact(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; overlapping spans become one."""
    name = unused(docs, "pii")
    found = with_spans(docs, detector or fit(docs), name)
    every = F.concat(*[F.transform(F.col(f"{name}.{k}"), _replaced(k)) for k in KINDS])
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:  # before: where the last span ended
        end = F.greatest(acc["end"], -s["back"]).cast("int")
        return F.struct((s["start"] >= acc["end"]).alias("apart"), acc["end"].alias("before"), s["start"].alias("start"), end.alias("end"), s["name"].alias("name"))

    begin = F.struct(F.lit(False).alias("apart"), F.lit(0).alias("before"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("name"))
    ranked = scanned(F.array_sort(every), begin, step, "struct<apart:boolean,before:int,start:int,end:int,name:string>")
    # the text's signs are split once and cut by slices; a substring would count from the text's start for each span
    piece = lambda signs, a, b: F.array_join(F.slice(signs, a + 1, b - a), "")
    new = once(F.struct(F.split(text, "").alias("signs"), ranked.alias("spans")), lambda x: F.concat(
        F.array_join(F.transform(F.filter(x["spans"], lambda s: s["apart"]), lambda s: F.concat(piece(x["signs"], s["before"], s["start"]), s["name"])), ""),
        piece(x["signs"], F.element_at(x["spans"], -1)["end"], F.char_length(text)),
    ))
    return found.withColumn("text", F.when(F.size(every) > 0, new).otherwise(text)).select(*docs.columns)
