"""Personal data: overlapping candidate spans, chosen by boosted trees with calibrated thresholds.

Four generators find e-mail addresses, IPv4 addresses, card numbers and phone
numbers; their matches that pass the kind's check are always kept. Kept spans are masked, and in what is left a
wider generator proposes every token with a digit or an @, and the generators of numbers propose too.

Two sets of gradient-boosted trees judge a proposal without seeing what their labels come from. One sees its format only
and learns which formats follow words such as password or account; the other sees the surroundings only and
learns which of them checked matches and well-known shapes have. Both also learn from planted
values (``_planted``), as some kinds are rare. They are fitted on a bounded sample of proposals. The threshold of
each is set by a histogram over the proposals of a quarter of all documents, none of them in the sample, so that
``PRECISION`` of what it selects is personal by either rule. What one of them selects becomes a span of kind
``other``; of overlapping ones the first, the longest of those with one begin.

All of it is DataFrame functions: positions come from the lengths of matches and of
what lies between them, and the fitted trees are written out as an expression, so a
document never leaves its row and nothing is shuffled when documents are scanned.
Long arrays and texts are worked through in blocks, so time grows in proportion to a text's length.

Offsets count code points, ends are exclusive. Patterns are possessive and start at
the begin of a run only, so a very long run takes linear time.

Defined results: a NULL text counts as empty when spans are reported and stays NULL when
redacted; an empty text has no spans; without proposals in the sample only
the four kinds are found; a token that holds the private character of the mask is not proposed; repeated rows
are treated alike; other columns are kept.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.session import materialize

#: Leftmost matches of these equal those of the plain patterns without lookbehind and possessive repeats.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARD = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOKEN = r"(?<![^\s\"'<>,;=:()])[^\s\"'<>,;=:()0-9@]*+[0-9@][^\s\"'<>,;=:()]*(?<![.!?])"
MASK = "\ue000"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SECRET = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|credential|auth)[\"']?\s*[:=]\s*[\"']?$"
CONTACT = r"(?i)(?:e-?mail|phone|tel|fax|mobile|call|card|visa|host|addr)[a-z]*[.: ]*$"
IDENTITY = r"(?i)\b(?:ssn|social security|iban|passport|tax id|national id|account|acct|born|dob)(?: no| number)?[.#]?\s*[:=]?\s*$"
#: Shapes of social security numbers, international account numbers, access keys and long hexadecimal keys.
SHAPE = "^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|AKIA[A-Z0-9]{14,}|(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,})$"
FORMAT = "length digits letters ats dots dashes spaces hexes upper distinct plus mixed unlike".split()
CONTEXT = "assigned secret contact identity quoted".split()
LEAST_LENGTH = 4
BEFORE, AFTER = 24, 2
SAMPLE = 20_000
PLANTED = 600
FOLDS, BINS = 4, 1000
PRECISION = 0.99
TREES, DEPTH = 12, 4
SPAN = "struct<start:int,end:int,value:string,left:string,right:string>"
EMPTY = f"array<{SPAN}>"
BLOCK, CHARACTERS = 256, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _cut(values: Column, block: int) -> Column:
    """An array that is not empty as an array of blocks."""
    last = F.floor((F.size(values) - 1) / block).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * block + 1, F.lit(block)))


def running(numbers: Column, step: Callable[[Column, Column], Column], block: int = BLOCK) -> Column:
    """Running results of an int array, from 0 on; blocks keep the copying small for long arrays."""

    def run(values: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("last"))
        add = lambda acc, v: let(
            step(acc["last"], v), lambda now: F.struct(F.concat(acc["all"], F.array(now)).alias("all"), now.alias("last"))
        )
        return F.aggregate(values, start, add, lambda acc: acc["all"])

    def joined(parts: Column) -> Column:
        return let(
            run(F.transform(parts, lambda p: F.element_at(p, -1))),
            lambda heads: F.flatten(
                F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda v: step(F.get(heads, i - 1), v))))
            ),
        )

    return let(
        numbers,
        lambda values: F.when(F.size(values) == 0, values)
        .when(F.size(values) <= block, run(values))
        .otherwise(let(F.transform(_cut(values, block), run), joined)),
    )


def prefix_sums(numbers: Column) -> Column:
    return running(numbers, lambda a, b: a + b)


def prefix_maxima(numbers: Column) -> Column:
    """Of an array of numbers that are not negative."""
    return running(numbers, lambda a, b: F.greatest(a, b))


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """Start, end, value and surroundings of every match in a text that passes the guard."""
    none = F.array().cast(EMPTY)

    def span(found: Column, gaps: Column, ends: Column) -> Callable[[Column, Column], Column]:
        # Surroundings come from the neighbouring match and gap: cutting them out of the text would read it from its begin.
        return lambda v, i: F.struct(
            (F.get(ends, i) - F.length(v)).alias("start"),
            F.get(ends, i).alias("end"),
            v.alias("value"),
            F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), F.lit(BEFORE)).alias("left"),
            F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("right"),
        )

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda v, i: F.length(v) + F.length(F.get(gaps, i)))
        return let(prefix_sums(steps), lambda ends: F.transform(found, span(found, gaps, ends)))

    parts = let(
        F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")),
        lambda both: F.when(F.size(both["found"]) == 0, none).otherwise(placed(both["found"], both["gaps"])),
    )
    return F.when(guard, parts).otherwise(none)


def merged(spans: Column) -> Column:
    """Spans ``start, end, tag``, united where they overlap, in order; each named after the first in it."""

    def groups(s: Column) -> Column:
        return let(
            prefix_maxima(F.transform(s, lambda x: x["end"])),
            lambda most: let(
                F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(most, i - 1))),
                lambda firsts: F.transform(
                    firsts,
                    lambda i, k: F.struct(
                        F.get(s, i)["start"].alias("start"),
                        F.get(most, F.coalesce(F.get(firsts, k + 1), F.size(s)) - 1).alias("end"),
                        F.get(s, i)["tag"].alias("tag"),
                    ),
                ),
            ),
        )

    return let(F.array_sort(spans), lambda s: F.when(F.size(s) == 0, s).otherwise(groups(s)))


def replaced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """The text with ``put`` of each span in its place; spans are in order and apart."""

    def part(blocks: Column, a: Column, b: Column) -> Column:
        of = lambda i: F.coalesce(F.get(blocks, F.floor(i / CHARACTERS).cast("int")), F.lit(""))
        first, last = F.floor(a / CHARACTERS).cast("int"), F.floor(b / CHARACTERS).cast("int")
        between = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, F.substring(of(a), a % CHARACTERS + 1, b - a)).otherwise(
            F.concat(F.substring(of(a), a % CHARACTERS + 1, F.lit(CHARACTERS)), between, F.substring(of(b), F.lit(1), b % CHARACTERS))
        )

    def whole(blocks: Column) -> Column:
        pieces = F.transform(
            spans, lambda s, i: F.concat(part(blocks, F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]), s["start"]), put(s))
        )
        return F.concat(F.array_join(pieces, ""), part(blocks, F.element_at(spans, -1)["end"], F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARACTERS}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(blocks, whole))


def apart(spans: Column) -> Column:
    """Of spans in any order, the first, and each that begins after the last one taken; of those with one begin the longest."""
    none = F.array().cast(EMPTY)

    def take(acc: Column, s: Column) -> Column:
        more = F.struct(F.concat(acc["taken"], F.array(s)).alias("taken"), s["end"].alias("last"))
        return F.when(s["start"] >= acc["last"], more).otherwise(acc)

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(none.alias("taken"), acc["last"].alias("last"))
        return let(
            F.aggregate(part, start, take),
            lambda got: F.struct(F.concat(acc["taken"], F.array(got["taken"])).alias("taken"), got["last"].alias("last")),
        )

    start = F.struct(F.array().cast(f"array<{EMPTY}>").alias("taken"), F.lit(0).alias("last"))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s.alias("span")))
    return let(
        F.transform(F.array_sort(keyed), lambda k: k["span"]),
        lambda s: F.when(F.size(s) == 0, none).otherwise(F.aggregate(_cut(s, BLOCK), start, block, lambda acc: F.flatten(acc["taken"]))),
    )


def _luhn(digits: Column) -> Column:
    """Whether the checksum of a digit string is right."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)),
    )
    return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + d) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda v: let(_digits(v), lambda d: F.length(d).between(16, 19) & _luhn(d)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}
KINDS = list(PATTERNS)


def _passing(kind: str, wanted: bool = True) -> Callable[[Column], Column]:
    return lambda s: CHECKS[kind](s["value"]) == F.lit(wanted)


def _passing(kind: str) -> Callable[[Column], Column]:
    return lambda s: CHECKS[kind](s["value"])


def _tagged(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag"))


def _proposed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``__text``, an array of kept spans for each kind, and ``__wide``: the other proposals."""
    value, masked = F.col("__text"), F.col("__masked")
    some = lambda t: t.rlike("[0-9@]")
    of = lambda t, k: matches(t, PATTERNS[k], some(t) & F.contains(t, F.lit(GUARD[k])))
    out = docs.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    out = out.select("*", *[of(value, k).alias(f"__raw_{k}") for k in KINDS])
    out = out.select("*", *[F.filter(f"__raw_{k}", _passing(k)).alias(f"__{k}") for k in KINDS])
    kept = merged(F.concat(*[F.transform(f"__{k}", _tagged(k)) for k in KINDS]))
    out = out.withColumn("__held", kept)
    out = out.withColumn("__masked", replaced(value, F.col("__held"), lambda s: F.repeat(F.lit(MASK), s["end"] - s["start"])))
    tokens = F.filter(matches(masked, TOKEN, some(masked)), lambda s: ~F.contains(s["value"], F.lit(MASK)))
    wide = F.concat(tokens, *[F.filter(of(masked, k), lambda s: F.length(s["value"]) > 1) for k in KINDS if k != "email"])
    return out.withColumn("__wide", wide).drop("__held", "__masked", *[f"__raw_{k}" for k in KINDS])


def _flag(c: Column) -> Column:
    return c.cast("int").cast("double")


def _format(span: Column) -> list[Column]:
    """FORMAT of a span."""
    value = span["value"]
    size = lambda p: F.length(F.regexp_replace(value, p, "")).cast("double")
    return [
        F.length(value).cast("double"),
        size("[^0-9]"),
        size("[^A-Za-z]"),
        size("[^@]"),
        size("[^.]"),
        size("[^-_]"),
        size("[^ ()]"),
        size("[^0-9a-fA-F]"),
        size("[^A-Z]"),
        F.size(F.array_distinct(F.split(value, ""))).cast("double"),
        _flag(value.startswith("+")),
        _flag(value.rlike("[0-9]") & value.rlike("[A-Za-z]")),
        size("[A-Za-z0-9.@ ()_+-]"),
    ]


def _context(span: Column) -> list[Column]:
    """CONTEXT of a span."""
    left, right = span["left"], span["right"]
    return [
        _flag(left.rlike("[:=]\\s*[\"']?$")),
        _flag(left.rlike(SECRET)),
        _flag(left.rlike(CONTACT)),
        _flag(left.rlike(IDENTITY)),
        _flag(right.rlike("^[\"']")),
    ]


def _by_context(span: Column) -> Column:
    return (span["left"].rlike(SECRET) | span["left"].rlike(IDENTITY)) & (F.length(span["value"]) >= LEAST_LENGTH)


def _by_format(span: Column) -> Column:
    return span["value"].rlike(SHAPE)


def _planted(lefts: list[str], number: int = PLANTED, seed: int = 9) -> list[tuple[str, str, str, bool]]:
    """Seeded values of rare kinds: value, left, right, whether a word before it names its kind."""
    r = random.Random(seed)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    digit, upper, lower, hexes = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    kinds = [
        (lambda: f"{some(digit, 3)}-{some(digit, 2)}-{some(digit, 4)}", ["SSN: ", "ssn ", "Social Security number: "]),
        (lambda: some(upper, 2) + some(digit, r.randrange(14, 26)), ["IBAN: ", "iban ", "account "]),
        (lambda: "AKIA" + some(upper + digit, 16), ["access_key = ", "access key: ", 'token: "']),
        (lambda: some(hexes, r.choice([16, 20, 32, 40, 64])), ["secret=", "api_key: ", "auth = '"]),
        (lambda: "sk_" + some(lower + upper + digit, r.randrange(20, 40)), ["api-key=", 'secret: "']),
    ]
    rows = []
    for i in range(number):
        value, before = kinds[i % len(kinds)]
        named = i // len(kinds) % 2 == 0 or not lefts
        left = r.choice(before) if named else r.choice(lefts)
        rows.append((value(), left[-BEFORE:], '"' if left.endswith('"') else "'" if left.endswith("'") else " ", named))
    return rows


def _score(model) -> Callable[[Column], Column]:
    """The fitted trees as one expression over an array of features: the probability of the positive class."""

    def tree(node, values: Column) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        split = node.split()
        low = F.get(values, F.lit(split.featureIndex())) <= F.lit(float(split.threshold()))
        return F.when(low, tree(node.leftChild(), values)).otherwise(tree(node.rightChild(), values))

    roots = [(float(w), t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees)]

    def probability(values: Column) -> Column:
        margin = F.lit(0.0)
        for weight, root in roots:
            margin = margin + F.lit(weight) * tree(root, values)
        return 1 / (1 + F.exp(-2 * margin))

    return probability


Selector = Callable[[Column], Column]
VIEWS: dict[str, tuple[list[str], Callable[[Column], list[Column]]]] = {"format": (FORMAT, _format), "context": (CONTEXT, _context)}


def threshold_of(bins: list[tuple[int, int, int]]) -> float:
    """Least threshold from 0.5 on above which PRECISION of the counted (bin of BINS, number, personal ones) is kept."""
    bins = sorted(bins, reverse=True)
    number = good = 0
    lowest = -1
    for i, (_, n, y) in enumerate(bins):
        number, good = number + n, good + y
        if good >= PRECISION * number:
            lowest = i
    return 0.5 if lowest + 1 == len(bins) else max(0.5, (bins[lowest + 1][0] + 1) / BINS)


def train_selector(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Selector | None:
    """Fit the trees on at most ``sample`` proposals of about as many documents (least hash first); a test of a span."""
    spark = docs.sparkSession
    docs = docs.select(F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`")).alias("doc"), F.col(f"`{text}`").alias("text"))
    held_out = F.pmod("doc", F.lit(FOLDS)) == 0
    # Documents are cut by their hash before anything is sorted, so that a task holds its share of the sample and not the whole.
    cut = 2 * int(min(1.0, sample / max(docs.count(), 1) * FOLDS / (FOLDS - 1)) * 2**62) - 1
    chosen = docs.filter(~held_out & (F.shiftrightunsigned("doc", 1) <= cut)).dropDuplicates(["doc"])
    rows = _proposed(chosen, "text")
    marked = lambda c, known: F.transform(c, lambda s: F.struct(s.alias("s"), F.lit(known).alias("known")))
    kept = F.concat(*[marked(f"__{k}", True) for k in KINDS])
    rows = rows.select("doc", F.explode(F.concat(marked("__wide", False), kept)).alias("x")).select("doc", "x.s", "x.known")
    turn = F.xxhash64("doc", F.col("s.start"), F.col("s.value"))
    rows = materialize(rows.orderBy(turn, "known").limit(sample).select("s", "known"), "proposals")
    lefts = [r["l"] for r in rows.filter("not known").select(F.col("s.left").alias("l")).limit(200).collect()]
    if not lefts:
        return None
    planted = spark.createDataFrame(_planted(lefts), "value string, left string, right string, named boolean")
    span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), "value", "left", "right")
    planted = planted.select(span.alias("s"), "named")
    s, known = F.col("s"), F.col("known")
    labelled = {
        "format": rows.select("s", (known | _by_context(s)).alias("y")).union(planted.select("s", F.lit(True))),
        "context": rows.select("s", (known | _by_format(s)).alias("y")).union(planted.filter("named").select("s", F.lit(True))),
    }
    scores = {}
    for view, (names, features) in VIEWS.items():
        table = labelled[view].select(F.col("y").cast("double").alias("label"), *[f.alias(n) for n, f in zip(names, features(s))])
        table = materialize(VectorAssembler(inputCols=names, outputCol="features").transform(table).select("label", "features"), "views")
        if table.select("label").distinct().count() < 2:
            continue
        scores[view] = _score(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(table))
    probability = lambda view, x: let(F.array(*VIEWS[view][1](x)), scores[view])
    # Thresholds: proposals of all documents that are held out, counted by bin of their scores.
    judged = F.transform(
        "__wide",
        lambda x: F.struct(
            (_by_context(x) | _by_format(x)).alias("y"), *[F.floor(probability(v, x) * BINS).cast("int").alias(v) for v in scores]
        ),
    )
    held = _proposed(docs.filter(held_out), "text").select(F.explode(judged).alias("x")).select("x.*")
    limits = {}
    counted = [F.struct(F.lit(v).alias("view"), F.col(v).alias("bin")) for v in scores]
    if counted:
        counts = held.select("y", F.explode(F.array(*counted)).alias("x")).filter(F.col("x.bin") >= BINS // 2)
        counts = counts.groupBy("x.view", "x.bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("good")).collect()  # at most BINS a view
        limits = {v: threshold_of([(c["bin"], c["n"], c["good"]) for c in counts if c["view"] == v]) for v in scores}

    def selects(x: Column) -> Column:
        out = F.lit(False)
        for view, limit in limits.items():
            out = out | (probability(view, x) >= F.lit(limit))
        return out

    return selects


def _spans(docs: DataFrame, text: str, selector: Selector | None) -> DataFrame:
    """``docs`` with ``__text`` and one array of spans for each kind, ``__other`` last."""
    rows = _proposed(docs, text)
    if selector is None:
        return rows.withColumn("__other", F.array().cast(EMPTY))
    return rows.withColumn("__chosen", F.filter("__wide", selector)).withColumn("__other", apart(F.col("__chosen")))


def personal_data(docs: DataFrame, selector: Selector | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``id``, counts of the four kinds, hash of their spans, and all spans."""
    rows = _spans(docs.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("text")), "text", selector)
    written = lambda kind: F.transform(
        f"__{kind}", lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    )
    base = F.array_join(F.concat(*[written(k) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[written(k) for k in [*KINDS, "other"]]), ",")
    return rows.select(
        F.col("__id").alias(id),
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        every.alias("spans"),
    )


def redact(docs: DataFrame, selector: Selector | None, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; same columns.

    Spans that overlap become one, named after the first of them.
    """
    names = docs.columns
    rows = _spans(docs, text, selector)
    rows = rows.withColumn("__merged", merged(F.concat(*[F.transform(f"__{k}", _tagged(k)) for k in [*KINDS, "other"]])))
    done = replaced(F.col("__text"), F.col("__merged"), lambda s: s["tag"])
    rows = rows.withColumn("__done", F.when(F.col(f"`{text}`").isNotNull(), done))
    return rows.select(*[F.col("__done").alias(text) if c == text else F.col(f"`{c}`") for c in names])
