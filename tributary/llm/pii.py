"""Personal data found by candidate gradient boosting, in DataFrame operations only.

Generators, regular expressions of high recall, propose spans that may overlap: for
each kind its base pattern and a looser one, and on demand long runs that may be secrets.
Matches become rows with a little context; their places are running sums over a text's pieces, and what they meet is
told by running maxima, so a text of n matches costs n log n.  Base spans are base
matches whose checks hold (parts, digits, Luhn).

The model is learned from what can be labelled, and no label is read off a feature.  A
candidate that meets a base span of its kind is personal data; one that meets only base
spans of other kinds, or that is as long as a base match that fails its checks, is not;
what lies deeper in such a match, and what meets none, may be either and isn't learned
from.  A run that a credential's name is assigned to is a secret, one without such a name
isn't; the model sees no names, only the run's form and what stands next to it, so it
also takes those of the same form whose name it doesn't know, as long as these are few
enough for the precision asked for.  Labelled candidates
are grouped by binned features over all documents, and on that table, bounded by the
bins, the driver boosts small trees and picks for each kind the lowest score at which
enough of the held-out candidates are right.  The trees become conditional expressions;
loose candidates above their kind's threshold that touch no base span are added, such as
numbers in other notations and those that a base match swallowed with their neighbours.

Defined results: null text is empty, with no spans; repeated rows give one row each;
without labelled candidates the model adds nothing; columns other than those named
aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, sieve, table

KINDS = ["email", "ip", "card", "phone"]
#: Kinds in the order of their numbers; secrets have no base pattern.
SECRET = len(KINDS)
ALL = [*KINDS, "secret"]

#: The base patterns. Possessive repeats can't change what these match, and don't use the stack.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms of each kind.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}",
    "card": r"[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}",
    "phone": r"\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,5}",
}
#: Texts that don't match these hold no candidate of the kind; they are cheap to search for.
HINT = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9](?:\.[0-9]|\[\.|\(\.|\[dot|\(dot)", "card": r"[0-9](?:[\x20.-]?[0-9]){11}", "phone": r"[+]?[0-9][\x20().0-9-]+[0-9]"}

#: What may be a secret; a name that makes it one stands before it.
RUN = r"[A-Za-z0-9_+/=-]{16,}+"
LONG = r"[A-Za-z0-9_+/=-]{16}"
NAMED = r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|credentials?)[\"']?\s*(?:=>|[=:])\s*[\"']?$"
ASSIGNED = r"(?:=>|[=:])\s*[\"']?$"

CONTEXT = 24
CUES = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|visa|account|pay", "phone": "tel|phone|call|fax|mobile"}
MATCH = "struct<g:int,i:int,gap:int,match:string,left:string,right:string>"


def found(pattern: str, g: int, text: str = "_text") -> Column:
    """The leftmost non-overlapping matches of generator g: the code points before each since the last, and what stands around it."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    pieces = f"array(named_struct('m', regexp_extract_all({text}, '{p}', 0), 's', split({text}, '{p}', -1)))"
    each = f"named_struct('g', {g}, 'i', i, 'gap', char_length(z.s[i]), 'match', x, 'left', right(z.s[i], {CONTEXT}), 'right', left(z.s[i + 1], 1))"
    return F.expr(f"transform({pieces}, z -> transform(z.m, (x, i) -> {each}))[0]").cast(f"array<{MATCH}>")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(2 * c.cast("int") / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the kind's base pattern counts."""
    n = F.length(digits(match))
    if kind == "ip":
        part = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(F.substring(part(x), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return (n >= 16) & (n <= 19) & luhn(F.when((n >= 16) & (n <= 19), digits(match)).otherwise("1"))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def sound(kind: str, match: Column) -> Column:
    """Whether a match in any notation has the format of its kind."""
    n = F.length(digits(match))
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    if kind == "email":
        return match.rlike(r"(?:\.|dot\))\x20?[A-Za-z]{2,}$|dot\]\x20?[A-Za-z]{2,}$")
    if kind == "ip":
        return valid("ip", F.regexp_replace(match, "[^0-9]+", "."))
    if kind == "card":
        return (n >= 13) & (n <= 19) & luhn(F.when((n >= 13) & (n <= 19), digits(match)).otherwise("1"))
    return (n >= 8) & (n <= 15)


def shape(c: Column) -> Column:
    """0 nothing or white space, 1 letter, 2 digit, 3 other."""
    return F.when(c.rlike(r"^\s*$"), 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)


def by_kind(f) -> Column:
    """f(kind) of each row's kind."""
    out = f(ALL[-1])
    for k, kind in reversed(list(enumerate(ALL[:-1]))):
        out = F.when(F.col("kind") == k, f(kind)).otherwise(out)
    return out


#: Format and context of a candidate, each a small integer; BINS bounds it.
#: The last two are of secrets alone, which have no inner, n_groups, lead and parens.
BINS = {"kind": 5, "sound": 2, "inner": 2, "n_digits": 20, "n_groups": 5, "lead": 3, "left": 4, "right": 4, "cue": 2, "parens": 2, "size": 6, "cases": 4}


def features() -> Column:
    m, secret = F.col("match"), F.col("kind") == SECRET
    other = lambda c: F.when(secret, 0).otherwise(c)
    return F.struct(
        F.col("kind").alias("kind"),
        F.col("sound").cast("int").alias("sound"),
        other(F.col("inner").cast("int")).alias("inner"),
        F.least(F.length(digits(m)), F.lit(19)).alias("n_digits"),
        other(F.least(F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))), F.lit(4))).alias("n_groups"),
        other(F.when(m.startswith("+"), 1).when(F.contains(m, F.lit("@")), 2).otherwise(0)).alias("lead"),
        shape(F.right("left", F.lit(1))).alias("left"),
        shape(F.coalesce("right", F.lit(""))).alias("right"),
        F.when(by_kind(lambda kind: F.col("left").rlike(ASSIGNED) if kind == "secret" else F.lower("left").rlike(CUES[kind])), 1).otherwise(0).alias("cue"),
        F.when(F.contains(m, F.lit("(")), 1).otherwise(0).alias("parens"),
        F.when(secret, F.least(F.floor(F.log2(F.length(m) / 16.0)).cast("int"), F.lit(5))).otherwise(0).alias("size"),
        F.when(secret, sum((m.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))).otherwise(0).alias("cases"),
    )


def meets(which: Column, *by: str) -> Column:
    """Whether a span shares a place with one that is which, of the same text (and by)."""
    over = Window.partitionBy("_row", *by)
    before = F.max(F.when(which, F.col("end"))).over(over.orderBy("start")) > F.col("start")
    after = F.min(F.when(which, F.col("start"))).over(over.orderBy(F.col("start").desc())) < F.col("end")
    return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))


def equal(which: Column, *by: str) -> Column:
    """Whether a span has both ends of one that is which."""
    return F.coalesce(F.max(which).over(Window.partitionBy("_row", *by, "start", "end")), F.lit(False))


def inner() -> Column:
    """Whether a candidate lies in a longer one of another kind, secrets apart."""
    over = Window.partitionBy("_row").orderBy("start")

    def furthest(window):
        return F.greatest(*(F.when(F.col("kind") != k, F.max(F.when(F.col("kind") == k, F.col("end"))).over(window)) for k in range(len(KINDS))))

    longer = (furthest(over) > F.col("end")) | (furthest(over.rangeBetween(Window.unboundedPreceding, -1)) >= F.col("end"))
    return F.coalesce(longer, F.lit(False))


def candidates(docs: DataFrame, secrets: bool = False) -> DataFrame:
    """All candidates, secrets among them if asked for, as a table: doc_id, key (row_key), kind, start, end, base, loose, f (features), label (1, 0 or null),
    free (touches no base span), part (0: to learn from, 1: held out). Rows that repeat id and text give one set of them."""
    df = docs.select(docs["doc_id"].alias("doc_id"), row_key(docs["doc_id"], docs["text"]).alias("key"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    none = F.array().cast(f"array<{MATCH}>")
    each = [F.when(F.col("_text").rlike(HINT[kind]), F.concat(found(BASE[kind], 2 * k), found(LOOSE[kind], 2 * k + 1))).otherwise(none) for k, kind in enumerate(KINDS)]
    if secrets:
        each.append(F.when(F.col("_text").rlike(LONG), found(RUN, 2 * SECRET + 1)).otherwise(none))
    # A digit, an at sign or a long run must be there at all.
    rows = df.where(F.col("_text").rlike(r"[0-9]|@|[\[(]at[\])]" + (f"|{LONG}" if secrets else ""))).select("doc_id", "key", F.monotonically_increasing_id().alias("_row"), F.concat(*each).alias("cs"))
    rows = rows.select("doc_id", "key", "_row", F.explode("cs").alias("c")).select("doc_id", "key", "_row", "c.*")
    end = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("_row", "g").orderBy("i")).cast("int")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).withColumn("kind", F.floor(F.col("g") / 2).cast("int")).withColumn("loose", F.col("g") % 2 == 1)
    rows = rows.withColumn("base", ~F.col("loose") & by_kind(lambda kind: valid(kind, F.col("match")))).withColumn("sound", by_kind(lambda kind: sound(kind, F.col("match"))))
    rows = rows.withColumn("good", meets(F.col("base"), "kind")).withColumn("bad", equal(~F.col("loose") & ~F.col("base"), "kind")).withColumn("free", ~meets(F.col("base"))).withColumn("inner", inner())
    # Where another run ends a few characters before, the name may be in it.
    seen = (F.col("i") == 0) | (F.col("gap") >= CONTEXT)
    run = F.when(~F.col("free"), 0).when(F.col("left").rlike(NAMED), 1).when(seen, 0)
    label = F.when(F.col("kind") == SECRET, run).when(F.col("good"), 1).when(F.col("bad") | ~F.col("free"), 0)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("part")
    return table(rows.select("doc_id", "key", "kind", "start", "end", "base", "loose", features().alias("f"), label.alias("label"), "free", part).distinct(), "pii")


@dataclass(frozen=True)
class Tree:
    """A leaf's value, or a split: feature < cut goes left."""

    value: float = 0.0
    feature: str = ""
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def score(self, x: dict[str, int]) -> float:
        if self.left is None:
            return self.value
        return (self.left if x[self.feature] < self.cut else self.right).score(x)

    def column(self, f: Column) -> Column:
        if self.left is None:
            return F.lit(float(self.value))
        return F.when(f[self.feature] < self.cut, self.left.column(f)).otherwise(self.right.column(f))


@dataclass(frozen=True)
class Model:
    """Boosted trees over a start value, and for each kind the score from which a candidate is taken (None: never)."""

    start: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float | None, ...]

    def score(self, x: dict[str, int]) -> float:
        return self.start + sum(t.score(x) for t in self.trees)

    def column(self, f: Column) -> Column:
        out = F.lit(self.start)
        for t in self.trees:
            out = out + t.column(f)
        return out

    def takes(self, f: Column) -> Column:
        out = F.lit(False)
        s = self.column(f)
        for k, t in enumerate(self.thresholds):
            if t is not None:
                out = out | ((f["kind"] == k) & (s >= t))
        return out


Row = tuple[dict[str, int], float, float]  # features, weight of valid candidates, weight of others


def grow(rows: Sequence[tuple[dict, float, float]], depth: int, least: float) -> Tree:
    """A regression tree on (features, gradient sum, hessian sum), by Newton gain."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    value = g / (h + 1.0)
    best = (1e-6, None)
    if depth:
        for f, n in BINS.items():
            sums = [[0.0, 0.0] for _ in range(n)]
            for x, a, b in rows:
                sums[x[f]][0] += a
                sums[x[f]][1] += b
            gl = hl = 0.0
            for cut in range(1, n):
                gl, hl = gl + sums[cut - 1][0], hl + sums[cut - 1][1]
                if hl >= least and h - hl >= least:
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (f, cut))
    if best[1] is None:
        return Tree(value)
    f, cut = best[1]
    return Tree(0.0, f, cut, grow([r for r in rows if r[0][f] < cut], depth - 1, least), grow([r for r in rows if r[0][f] >= cut], depth - 1, least))


def boost(rows: Sequence[Row], held: Sequence[Row], rounds: int = 20, depth: int = 3, rate: float = 0.3, precision: float = 0.9) -> Model:
    """Trees for the log-odds of being valid, and calibrated thresholds on the held-out rows."""
    pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not pos:
        return Model(0.0, (), (None,) * len(ALL))
    start = log((pos + 1) / (neg + 1))
    scores, trees = [start] * len(rows), []
    for _ in range(rounds):
        parts = []
        for (x, p, n), s in zip(rows, scores):
            q = 1 / (1 + exp(-s))
            parts.append((x, rate * (p * (1 - q) - n * q), (p + n) * q * (1 - q)))
        tree = grow(parts, depth, 0.5)
        trees.append(tree)
        scores = [s + tree.score(x) for (x, _, _), s in zip(rows, scores)]
    model = Model(start, tuple(trees), ())
    thresholds = []
    for k in range(len(ALL)):
        by_score: dict[float, list[float]] = {}
        for x, p, n in held:
            if x["kind"] == k:
                got = by_score.setdefault(round(model.score(x), 9), [0.0, 0.0])
                got[0] += p
                got[1] += n
        p = n = 0.0
        best = None
        for s in sorted(by_score, reverse=True):
            p, n = p + by_score[s][0], n + by_score[s][1]
            if p and p / (p + n) >= precision:
                best = s - 1e-6
        thresholds.append(best)
    return Model(start, tuple(trees), tuple(thresholds))


def counted(found_: DataFrame) -> list[tuple[dict[str, int], list[float]]]:
    """Labelled candidates by features: how many are right and wrong, in the learning part and the held-out part.
    At most as many rows as there are bins."""
    rows = found_.where("label is not null").groupBy("f").agg(
        *(F.count_if((F.col("part") == p) & (F.col("label") == ok)).alias(n) for n, p, ok in (("p0", 0, 1), ("n0", 0, 0), ("p1", 1, 1), ("n1", 1, 0)))
    )
    return [(r.f.asDict(), [float(r.p0), float(r.n0), float(r.p1), float(r.n1)]) for r in rows.toLocalIterator()]


def train(found_: DataFrame, **how) -> Model:
    """A model from candidates()."""
    rows = sorted(counted(found_), key=lambda r: sorted(r[0].items()))
    return boost([(x, c[0], c[1]) for x, c in rows if c[0] + c[1]], [(x, c[2], c[3]) for x, c in rows if c[2] + c[3]], **how)


def spans(found_: DataFrame, model: Model) -> DataFrame:
    """doc_id, key, spans: an array of kind, start, end, base and back for each text with base spans or candidates that
    the model takes and that meet none; by kind and start. back: where all spans that begin before it have ended."""
    taken = F.col("base") | (F.col("loose") & F.col("free") & model.takes(F.col("f")))
    rows = found_.where(taken).select("doc_id", "key", "kind", "start", "end", "base").distinct()
    before = Window.partitionBy("doc_id", "key").orderBy("start", F.col("end").desc(), "kind", F.col("base").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("back", F.coalesce(F.max("end").over(before), F.lit(0)))
    return rows.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base", "back"))).alias("spans"))


NO_SPANS = "cast(array() as array<struct<kind:int,start:int,end:int,base:boolean,back:int>>)"


def with_spans(docs: DataFrame, *keep: str, secrets: bool = False) -> DataFrame:
    """_row (a struct of the columns to keep) and _spans of every row. Only rows that may have spans are shuffled."""
    found_ = candidates(docs, secrets)
    known = table(spans(found_, train(found_)), "spans").select(F.col("doc_id").alias("_id"), F.col("key").alias("_known"), F.col("spans").alias("_spans"))
    packed = docs.select(F.struct(*(docs[c] for c in keep)).alias("_row"), docs["doc_id"].alias("_doc"), row_key(docs["doc_id"], docs["text"]).alias("_key"))
    maybe, rest = sieve(packed, known.select(F.col("_known").alias("_key")), "_key")
    hit = maybe.join(known, (F.col("_key") == F.col("_known")) & F.col("_doc").eqNullSafe(F.col("_id")), "left").select("_row", F.coalesce("_spans", F.expr(NO_SPANS)).alias("_spans"))
    return hit.unionByName(rest.select("_row", F.expr(NO_SPANS).alias("_spans")))


def find(docs: DataFrame, secrets: bool = False) -> DataFrame:
    """doc_id, spans (array of kind, start, end, base, back; kind as an index into ALL) of every row."""
    return with_spans(docs, "doc_id", secrets=secrets).select(F.col("_row")["doc_id"].alias("doc_id"), F.col("_spans").alias("spans"))


def written(spans_: Column | str) -> Column:
    names = F.array(*(F.lit(k) for k in ALL))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, secrets: bool = False) -> DataFrame:
    """Counts of base spans, their digest, all spans in writing, and how many the model added."""
    df = find(docs, secrets)
    base = F.filter("spans", lambda s: s["base"])

    def of(i):
        return lambda s: s["kind"] == i

    counts = [F.size(F.filter(base, of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def redacted(text: Column, spans_: Column) -> Column:
    """The text with <KIND> for each span; overlapping ones become one, named after the first. The text is cut as UTF-32,
    where a place is found without counting from the start."""
    tags = F.array(*(F.lit(f"<{k.upper()}>") for k in ALL))
    mark = F.to_binary(F.lit("0000FEFF"), F.lit("hex"))  # so that one in the text is kept

    def made(b):
        def cut(lo, hi):
            return F.decode(F.concat(mark, F.substring(b, 4 * lo + 1, 4 * (hi - lo))), "UTF-32")

        first = F.filter(spans_, lambda s: s["start"] >= s["back"])
        order = F.array_sort(F.transform(first, lambda s: F.struct(s["start"].alias("start"), s["back"].alias("back"), s["kind"].alias("kind"))))
        # Of spans that begin at one place the longest comes first, and the others begin before its end.
        out = F.transform(order, lambda s: F.concat(cut(s["back"], s["start"]), F.element_at(tags, s["kind"] + 1)))
        last = F.array_max(F.transform(spans_, lambda s: s["end"]))
        return F.concat(F.array_join(out, ""), cut(last, F.floor(F.octet_length(b) / 4).cast("int")))

    return F.element_at(F.transform(F.array(F.encode(text, "UTF-32")), made), 1)


def redact(docs: DataFrame, secrets: bool = False) -> DataFrame:
    """The documents with <KIND> for their spans; n_chars, if there, is the new length. Rows without spans are unchanged."""
    columns = docs.columns
    changed = F.size("_spans") > 0
    df = with_spans(docs, *columns, secrets=secrets).select("_row", F.when(changed, redacted(F.col("_row")["text"], F.col("_spans"))).alias("_new"), changed.alias("_changed"))
    out = []
    for c in columns:
        old = F.col("_row")[c]
        if c == "text":
            old = F.when(F.col("_changed"), F.col("_new")).otherwise(old)
        elif c == "n_chars":
            old = F.when(F.col("_changed"), F.length("_new").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return df.select(*out)
