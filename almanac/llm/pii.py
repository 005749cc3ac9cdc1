"""Personal data: base patterns, and further spans chosen by boosted trees over wide candidates.

Generators with high recall propose overlapping spans. Their format and context become features
of gradient-boosted trees, which are trained on weak labels (does the span, once spacing and
disguise are undone, pass the checks of its kind?), and a threshold for each kind is calibrated
on rows that the trees have not seen. Trees are turned into one SQL expression, so patterns,
checks, features and scores all run inside the row: no shuffle, no Python, and no key is needed.

All but the trees is built of column functions, not of SQL text, and a value that is used more
than once is named by ``_let``: parsing long texts and planning copies of long expressions took
more of the driver's memory than the work itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir, materialize

KINDS = ("email", "ip", "card", "phone")
#: Candidates that the trees see at most, in equal shares for each kind and label, chosen by a
#: hash of their text and place. Thresholds are set by all others.
MAX_CANDIDATES = 8000
TREES, DEPTH = 10, 3
#: Share of spans above a threshold that must be right by their weak labels.
PRECISION = 0.98
NEVER = 2.0
CHUNK = 64
#: Characters of context on each side of a candidate, up to the next one of its kind.
BEFORE, AFTER = 16, 8
#: Steps of a search among the spans of one kind in one text: enough for any text.
HALVINGS = 31

# Possessive repeats and the conditions at the front keep these linear in the text; what they
# match is what the plain patterns match. A run that failed from its first character would fail
# from its later ones too, so only its beginning, or the end of the match before, is tried.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?: ?(?:@|\(at\)|\[at\]) ?)[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,30}+",
    "phone": r"(?:\+|\()[0-9](?:[\x20()./-]{0,3}[0-9]){6,30}+",
}
Function = Callable[[Column], Column]


def _let(value: Column, use: Function) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _if(condition: Column, then: Column, other: Column) -> Column:
    return F.when(condition, then).otherwise(other)


def _struct(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _add(a: Column, x: Column) -> Column:
    return a + x


def _needed(kind: str, text: Column) -> Column:
    """Texts without this are not searched; the same for base and wide patterns but for emails."""
    if kind == "email":
        return text.contains("@") | text.contains("(at)") | text.contains("[at]")
    return text.rlike("[0-9]")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card(digits: Column) -> Column:
    """Whether 12 to 19 digits pass Luhn's check."""

    def step(a: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        return a + _if(i % 2 == 1, digit, digit * 2 - _if(digit > 4, F.lit(9), F.lit(0)))

    passes = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0
    return _if(F.length(digits).between(12, 19), passes, F.lit(False))


def _parts(v: Column) -> Column:
    """Whether no part between dots is above 255."""

    def above(part: Column) -> Column:
        return (F.length(part) > 3) | (F.concat(F.lit("0"), F.right(part, F.lit(3))).cast("int") > 255)

    return ~F.exists(F.transform(F.split(v, "[.]"), lambda p: F.ltrim(p, F.lit("0"))), above)


def _valid(kind: str, v: Column) -> Column:
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: _parts(v),
        "card": lambda: _let(_digits(v), _card),
        "phone": lambda: F.length(_digits(v)).between(9, 15),
    }[kind]()


def _chunks(n: Column) -> Column:
    """Numbers of the chunks of an array of size ``n``."""
    return _if(n == 0, F.array().cast("array<int>"), F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")))


def _chunk(array: Column, c: Column) -> Column:
    return F.slice(array, c * CHUNK + 1, F.lit(CHUNK))


def _located(pattern: str, needs: Column) -> Column:
    """All matches in ``__text`` in order, ``array<struct<start, end, v, before, after>>``, with what stands
    between them and their neighbours, at most ``BEFORE`` and ``AFTER`` characters of it.

    What ``split`` leaves between matches tells where they are. Lengths are added up in chunks,
    each beginning where those before it end, so the cost stays near the number of matches.
    """
    none, text = F.array().cast("array<string>"), F.col("__text")

    def places(x: Column) -> Column:
        # x: matches m, pieces p, and for each match what stands before it: the piece, and the match before that
        def inside(y: Column) -> Column:
            def chunk(c: Column) -> Column:
                def found(base: Column) -> Column:
                    def one(m: Column, i: Column) -> Column:
                        start = base + F.aggregate(F.slice(y["l"], c * CHUNK + 1, i + 1), F.lit(0), _add)
                        before = F.right(F.get(x["p"], c * CHUNK + i), F.lit(BEFORE))
                        after = F.left(F.get(x["p"], c * CHUNK + i + 1), F.lit(AFTER))
                        return _let(start, lambda s: _struct(start=s, end=s + F.length(m), v=m, before=F.lower(before), after=F.lower(after)))

                    return F.transform(_chunk(x["m"], c), one)

                return _let(F.aggregate(F.slice(y["s"], F.lit(1), c), F.lit(0), _add), found)

            return F.flatten(F.transform(_chunks(F.size(x["m"])), chunk))

        def sums(lengths: Column) -> Column:
            return F.transform(_chunks(F.size(lengths)), lambda c: F.aggregate(_chunk(lengths, c), F.lit(0), _add))

        lengths = F.transform(x["m"], lambda m, i: F.length(F.get(x["p"], i)) + _if(i > 0, F.length(F.get(x["m"], i - 1)), F.lit(0)))
        return _let(_let(lengths, lambda each: _struct(l=each, s=sums(each))), inside)

    matches = _if(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), none)
    return _let(_let(matches, lambda m: _struct(m=m, p=_if(F.size(m) > 0, F.split(text, pattern, -1), none))), places)


def _bases(df: DataFrame) -> DataFrame:
    """Adds ``__b_<kind>``: the valid base spans of each kind, ``array<struct<start, kind number, end>>`` in order."""
    found = {}
    for number, kind in enumerate(KINDS):
        valid = F.filter(_located(BASE[kind], _needed(kind, F.col("__text"))), lambda s: _valid(kind, s["v"]))
        found[f"__b_{kind}"] = F.transform(valid, lambda s: _struct(start=s["start"], k=F.lit(number), end=s["end"]))
    return df.withColumns(found)


def _below(spans: Column, place: str, limit: Column) -> Column:
    """How many of the spans of one kind have their ``place`` below ``limit``, by halving.

    Spans of one kind don't overlap, so their starts and their ends both ascend.
    """

    def step(s: Column, _: Column) -> Column:
        def halved(half: Column) -> Column:
            below = F.get(spans, half)[place] < limit
            return _if(below, _struct(lo=half + 1, hi=s["hi"]), _struct(lo=s["lo"], hi=half))

        return _if(s["lo"] >= s["hi"], s, _let(F.shiftright(s["lo"] + s["hi"], 1), halved))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return F.aggregate(steps, _struct(lo=F.lit(0), hi=F.size(spans)), step)["lo"]


def _touches(spans: Column, c: Column) -> Column:
    """Whether a span of one kind overlaps ``c``: the last one that begins before ``c`` ends, ends behind its start."""
    last = F.get(spans, _below(spans, "start", c["end"]) - 1)
    return _if(F.size(spans) == 0, F.lit(False), F.coalesce(last["end"] > c["start"], F.lit(False)))


def _candidates(df: DataFrame) -> DataFrame:
    """Adds ``__w_<kind>``: candidates of each kind in order, with what stands around them."""
    return df.withColumns({f"__w_{kind}": _located(WIDE[kind], _needed(kind, F.col("__text"))) for kind in KINDS})


def _featured(kind: str) -> Column:
    """The candidates ``c`` of a kind with their features ``c.f``."""
    number = F.lit(KINDS.index(kind))

    def one(c: Column) -> Column:
        values = F.array(*[feature(c, number).cast("double") for feature in FEATURES.values()])
        return _struct(start=c["start"], k=number, end=c["end"], v=c["v"], f=values)

    return F.transform(f"__w_{kind}", one)


def _plain_email(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, r" ?[(\[]at[)\]] ?", "@"), r" ?[(\[]dot[)\]] ?", ".")


def _count(v: Column, character: str) -> Column:
    return F.length(v) - F.length(F.replace(v, F.lit(character), F.lit("")))


#: Features of a candidate ``c`` of kind ``k`` by name, as numbers.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "kind": lambda c, k: k,
    "length": lambda c, k: F.length(c["v"]),
    "digits": lambda c, k: F.length(_digits(c["v"])),
    "letters": lambda c, k: F.length(F.regexp_replace(c["v"], "[^A-Za-z]", "")),
    "spaces": lambda c, k: _count(c["v"], " "),
    "dots": lambda c, k: _count(c["v"], "."),
    "dashes": lambda c, k: _count(c["v"], "-"),
    "slashes": lambda c, k: _count(c["v"], "/"),
    "plus": lambda c, k: c["v"].startswith("+").cast("int"),
    "brackets": lambda c, k: c["v"].rlike(r"[(\[]").cast("int"),
    "at": lambda c, k: c["v"].contains("@").cast("int"),
    "luhn": lambda c, k: _valid("card", c["v"]).cast("int"),
    "small_parts": lambda c, k: ((k == 1) & _parts(c["v"])).cast("int"),
    "ending": lambda c, k: F.length(F.regexp_extract(c["v"], "[A-Za-z]*$", 0)),
    "joined_before": lambda c, k: c["before"].rlike("[a-z0-9]$").cast("int"),
    "joined_after": lambda c, k: c["after"].rlike("^[a-z0-9]").cast("int"),
    "cue": lambda c, k: c["before"].rlike("(tel|phone|call|mobile|fax|card|visa|mail|contact|host|addr)").cast("int"),
    "assigned": lambda c, k: c["before"].rlike('[=:"]').cast("int"),
}


def _label(c: Column) -> Column:
    """Weak label: the checks of the kind, after spacing and disguise are undone."""
    email = _plain_email(c["v"]).rlike("^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+$")
    phone = c["v"].startswith("+") & _valid("phone", c["v"])
    return F.when(c["k"] == 0, email).when(c["k"] == 1, _parts(c["v"])).when(c["k"] == 2, _valid("card", c["v"])).otherwise(phone)


@dataclass(frozen=True)
class Model:
    """Probability of a candidate ``c`` (with features ``c.f``) as SQL, and the threshold of each kind."""

    sql: str
    thresholds: tuple[float, ...]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__text", F.coalesce("text", F.lit("")))


def fit(docs: DataFrame, max_candidates: int = MAX_CANDIDATES) -> Model:
    """Trees from at most ``max_candidates`` candidates of ``docs``, and thresholds from all that they have not seen.

    A kind and label with few candidates leaves its share to the others, so up to the bound all
    are drawn; three quarters of what is drawn trains. Without candidates of both labels nothing
    is added to the base spans.
    """
    found = _candidates(_texts(docs.select("text"))).select(F.explode(F.concat(*[_featured(kind) for kind in KINDS])).alias("c"))
    rows = found.select(
        _label(F.col("c")).cast("double").alias("label"), F.col("c.k").alias("k"), F.col("c.f").alias("f"), F.xxhash64("c.v", "c.start").alias("place")
    )
    turn = F.row_number().over(Window.partitionBy("k", "label").orderBy("place", "f"))
    drawn = rows.withColumn("turn", turn).where(F.col("turn") <= max_candidates)
    drawn = materialize(drawn.orderBy("turn", "k", "label").limit(max_candidates).orderBy("place", "label", "k", "f"), "candidates")
    counts = drawn.groupBy("label").count().collect()
    if len(counts) < 2:
        return Model("0D", (NEVER,) * len(KINDS))
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    ensure_checkpoint_dir(docs.sparkSession)
    check = F.pmod("place", F.lit(4)) == 3
    train = drawn.where(~check).select("label", array_to_vector("f").alias("features")).coalesce(1)
    if train.select("label").distinct().count() < 2:
        return Model("0D", (NEVER,) * len(KINDS))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, checkpointInterval=-1).fit(train)
    terms = [f"{weight!r}D * {_tree(tree._call_java('rootNode'))}" for weight, tree in zip(model.treeWeights, model.trees)]
    sql = f"1D / (1D + exp(-2D * ({' + '.join(terms)})))"
    # Up to the last place drawn of its kind and label a candidate was drawn, after it none was.
    lasts = drawn.groupBy("k", "label").agg(F.max("place").alias("last")).collect()
    last = "case " + " ".join(f"when k = {r['k']} and label = {r['label']!r}D then {r['last']}L" for r in lasts) + " end"
    seen = F.coalesce(~check & (F.col("place") <= F.expr(last)), F.lit(False))
    return Model(sql, _thresholds(rows.select("k", "label", F.expr(sql.replace("c.f", "f")).alias("score"), seen.alias("seen"))))


def _tree(node) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{node.prediction()!r}D"
    split = node.split()
    return f"if(c.f[{split.featureIndex()}] <= {split.threshold()!r}D, {_tree(node.leftChild())}, {_tree(node.rightChild())})"


def _thresholds(scored: DataFrame) -> tuple[float, ...]:
    """For each kind the lowest score from which on at least ``PRECISION`` of the unseen candidates are right.

    A kind of which the trees have seen every candidate is judged by those.
    """
    levels: dict[tuple, list] = {}
    for r in scored.groupBy("k", "score", "seen").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n")).collect():
        levels.setdefault((r["k"], r["seen"]), []).append((r["score"], r["right"], r["n"]))
    out = []
    for number in range(len(KINDS)):
        best, right, n = NEVER, 0.0, 0
        for score, more, count in sorted(levels.get((number, False), levels.get((number, True), [])), reverse=True):
            right, n = right + more, n + count
            if right >= PRECISION * n:
                best = score
        out.append(float(best) if best >= 0.5 else NEVER)
    return tuple(out)


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``base`` and ``spans``, each ``array<struct<start, k, end>>`` in order; ``k`` numbers ``KINDS``,
    places are code points with the end exclusive. ``spans`` holds ``base`` and what the model adds.

    A candidate is added if its score reaches its kind's threshold, no base span overlaps it and
    no better added one does. Null and empty texts have none. Columns of these names are
    replaced, others pass through.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base", "spans") and not c.startswith("__")])
    df = _bases(_texts(kept))
    base = F.concat(*[F.col(f"__b_{kind}") for kind in KINDS])
    used = [(kind, number) for number, kind in enumerate(KINDS) if model.thresholds[number] < NEVER]
    if not used:
        return _fixed(df, kept.columns, base=F.array_sort(base), spans=F.array_sort(base))
    df = _candidates(df).withColumn("__f", F.concat(*[_featured(kind) for kind, _ in used]))
    scored = f"transform(__f, c -> named_struct('start', c.start, 'k', c.k, 'end', c.end, 'score', {model.sql}))"
    df = df.withColumn("__s", F.expr(scored))
    least = F.array(*[F.lit(threshold) for threshold in model.thresholds])
    good = F.filter("__s", lambda c: c["score"] >= F.get(least, c["k"]))
    for kind in KINDS:
        good = F.filter(good, lambda c: ~_touches(F.col(f"__b_{kind}"), c))
    df = df.withColumn("__a", good)
    df = df.withColumns({f"__a_{kind}": F.filter("__a", lambda c: c["k"] == number) for kind, number in used})
    single = F.col("__a")
    for kind, number in used:
        single = F.filter(single, lambda c: (c["k"] == number) | ~_beaten(c, F.col(f"__a_{kind}")))
    single = F.transform(single, lambda c: _struct(start=c["start"], k=c["k"], end=c["end"]))
    return _fixed(df, kept.columns, base=F.array_sort(base), spans=F.array_sort(F.concat(base, single)))


def _beaten(c: Column, others: Column) -> Column:
    """Whether a better candidate among those of another kind overlaps ``c``; those that overlap it follow each other."""

    def better(o: Column) -> Column:
        longer, shorter = o["end"] - o["start"], c["end"] - c["start"]
        first = _struct(start=o["start"], k=o["k"]) < _struct(start=c["start"], k=c["k"])
        return (o["score"] > c["score"]) | ((o["score"] == c["score"]) & ((longer > shorter) | ((longer == shorter) & first)))

    def among(first: Column) -> Column:
        n = F.greatest(_below(others, "start", c["end"]) - first, F.lit(0))
        return F.exists(F.slice(others, first + 1, n), better)

    return _if(F.size(others) == 0, F.lit(False), _let(_below(others, "end", c["start"] + 1), among))


def _fixed(df: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """``columns`` of ``df`` and what is ``made`` of the others.

    The row passes a generator that gives it back: a filter on what is made would else be moved
    below it, with a copy of the whole search for each time that the search is named.
    """
    return df.select(*[F.col(f"`{c}`") for c in columns], F.inline(F.array(_struct(**made))))


def count_of(kind: str, spans: str = "base") -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["k"] == number)).cast("long")


def listed(spans: str) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def redact(found: DataFrame) -> DataFrame:
    """Replaces every stretch of ``text`` that ``spans`` cover by the kind of its first span in brackets, and drops
    ``base`` and ``spans``. A null text stays null.

    The text is cut once for about every root of the number of spans, and each cut once a span,
    so the cost stays near the length of the text.
    """
    spans, text = F.col("spans"), F.col("text")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def furthest(a: Column, span: Column) -> Column:
        return F.greatest(a, span["end"])

    # where each span finds the text written so far: behind the furthest end of those before it
    ends = F.transform(_chunks(F.size(spans)), lambda c: F.aggregate(_chunk(spans, c), F.lit(0), furthest))

    def reached(ends: Column) -> Column:
        def chunk(c: Column) -> Column:
            def each(base: Column) -> Column:
                before = lambda i: F.aggregate(F.slice(spans, c * CHUNK + 1, i), F.lit(0), furthest)
                return F.transform(_chunk(spans, c), lambda s, i: F.greatest(base, before(i)))

            return _let(F.aggregate(F.slice(ends, F.lit(1), c), F.lit(0), lambda a, x: F.greatest(a, x)), each)

        return F.flatten(F.transform(_chunks(F.size(spans)), chunk))

    def written(x: Column) -> Column:
        at, size = x["at"], x["size"]

        def part(c: Column) -> Column:
            start = F.get(at, c * size)
            end = F.get(spans, F.least((c + 1) * size, F.size(spans)) - 1)["start"]
            return _struct(start=start, part=F.substring(text, start + 1, end - start))

        def pieces(c: Column) -> Column:
            def piece(p: Column) -> Function:
                def one(s: Column, i: Column) -> Column:
                    begin = F.get(at, c * size + i)
                    stretch = F.substring(p["part"], begin - p["start"] + 1, s["start"] - begin)
                    return _if(s["start"] < begin, F.lit(""), F.concat(stretch, F.get(names, s["k"])))

                return one

            return _let(part(c), lambda p: F.array_join(F.transform(F.slice(spans, c * size + 1, size), piece(p)), ""))

        last = F.floor((F.size(spans) - 1) / size).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), last), pieces), "")

    size = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(spans))).cast("int"))
    begun = _let(_struct(at=_let(ends, reached), size=size), written)
    rest = F.substring(text, F.aggregate(spans, F.lit(0), furthest) + 1, F.length(text))
    return found.withColumn("text", _if(F.size(spans) == 0, text, F.concat(begun, rest))).drop("base", "spans")
