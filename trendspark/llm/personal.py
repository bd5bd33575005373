"""Personal data by candidates and boosted trees, in DataFrame functions only.

Base detectors follow fixed patterns and checks. They run over a whole stretch of
characters, so a number directly beside another, or an address with a spelled-out "at",
escapes them. High-recall generators therefore propose further spans, which may overlap.
Each candidate has features of its format and of the characters around it, all in a few
bins. Candidates of all documents are counted by kind, features and fold; whether a
candidate is itself a base span is the weak label; a candidate inside a longer stretch that
a base pattern ran over in vain has none. A form that no base pattern can match (a phone number
without "+", a spelled-out address) is labelled by voters, namely check, surroundings and an
announcing word, and has no label where they do not agree. Boosted trees are fitted to these counts
(their number is bounded by the product of the bins, not by the documents), and for each
kind the lowest score whose candidates reach TARGET precision on the fold held back is its
threshold. A candidate above it that touches no base span, and no better candidate, is
added. The trees are applied as column expressions.

Edge cases: a null text is empty and has no spans; characters are counted as code points;
repeated rows get a row each; a table without candidates adds nothing; an empty table gives
no rows. A run of digits, separators or labels of any length is one match; candidates of one
text are compared with its spans one by one, so thousands in one text take long.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.tables import fold, table
from trendspark.scratch import cut

# fixed values: kinds in their order, base patterns, what a candidate may look like, words that announce a kind
KINDS = ("email", "ip", "card", "phone")
# A separator between two characters that it may join is written as JOINT before the search
# (one character for one), so that a run of any length is a run of one class: the engine
# recurses into each repetition of a group and would run out of stack on a long text.
JOINT = "\u0003"
JOINTS = {"email": (r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "."), "card": (r"(?<=[0-9])[ -](?=[0-9])", " ")}
_LOCAL = rf"(?:(?<![A-Za-z0-9._%+{JOINT}-])|\G)[A-Za-z0-9._%+{JOINT}-]++"
_LABELS = rf"[A-Za-z0-9-]++{JOINT}[A-Za-z0-9{JOINT}-]*+"
_SPELLED = rf"(?: ?[(\[](?i:dot)[)\]] ?[A-Za-z0-9{JOINT}-]++)"
BASE = {
    "email": rf"{_LOCAL}@{_LABELS}",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+){3}",
    "card": rf"[0-9][0-9{JOINT}]++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PROPOSED = {  # no address is spelled with a hundred dots
    "email": rf"{_LOCAL}(?:@| ?[(\[](?i:at)[)\]] ?)(?:{_LABELS}{_SPELLED}{{0,100}}+|[A-Za-z0-9-]++{_SPELLED}{{1,100}}+)",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
}
ANNOUNCED = {
    "email": r"(?i)mail|contact|write|adresse|correo|courriel", "ip": r"(?i)\bip\b|server|host|addr|servidor|serveur",
    "card": r"(?i)card|visa|pay|karte|tarjeta|carte", "phone": r"(?i)tel|phone|call|fax|mobil|llam|appel|ruf",
}
MARK, STAND_IN = "\u0001", "\u0002"
STEP = 64
AROUND = 24
FEATURES = ("digits", "groups", "dots", "plus", "bracket", "even", "check", "announced", "after_letter", "before_letter",
            "after_digits", "zero", "spelled")
FOLDS, HELD = 5, 1
ROUNDS, DEPTH, RATE = 16, 3, 0.3
TARGET = 0.95
LEAST = 20  # candidates that a threshold must rest on


def located(docs: DataFrame, name: str, pattern: str, there: Column, joint: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``name``: array of (first, last, found, before, after) of all matches, code points, last exclusive.

    ``joint`` is what to write as JOINT before the search, and what stands for it afterwards.

    The text is split at marks around the matches. Lengths are summed over blocks of STEP
    pieces and then within a block, so many matches in one text stay cheap. Each helper
    column is named more than once in the next step, which keeps Spark from inlining it.
    """
    pieces, size, blocks, before = (F.col(f"_{x}") for x in ("pieces", "size", "blocks", "before"))
    text = F.regexp_replace("text", joint[0], JOINT) if joint else F.col("text")
    plain = (lambda c: F.translate(c, JOINT, joint[1])) if joint else (lambda c: c)
    marked = F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}")
    zero, n = F.lit(0).cast("long"), F.size(pieces)
    add = lambda total, x: total + x
    block = lambda k: F.floor((2 * k + 1) / F.lit(STEP)).cast("int")

    def span(k: Column) -> Column:
        at, b = 2 * k + 1, block(k)
        within = F.aggregate(F.slice(size, b * STEP + 1, at - b * STEP), zero, add)
        first = F.get(before, b) + within
        return F.struct(first.alias("first"), (F.get(before, b) + within + F.get(size, at)).alias("last"),
                        plain(F.get(pieces, at)).alias("found"),
                        plain(F.right(F.get(pieces, at - 1), F.lit(AROUND))).alias("before"),
                        plain(F.left(F.get(pieces, at + 1), F.lit(1))).alias("after"))

    docs = docs.withColumn("_pieces", F.when(there, F.split(marked, MARK)).otherwise(F.array("text")))
    docs = docs.withColumn("_size", F.transform(pieces, lambda p: F.length(p).cast("long")))
    starts = F.sequence(F.lit(0), F.floor((n - 1) / F.lit(STEP)).cast("int"))
    docs = docs.withColumn("_blocks", F.transform(starts, lambda b: F.aggregate(F.slice(size, b * STEP + 1, F.lit(STEP)), zero, add)))
    docs = docs.withColumn("_before", F.transform(
        F.sequence(F.lit(0), F.size(blocks) - 1), lambda b: F.aggregate(F.slice(blocks, F.lit(1), b), zero, add)))
    kind = "array<struct<first:bigint,last:bigint,found:string,before:string,after:string>>"
    return docs.withColumn(name, F.when(n >= 3, F.transform(F.sequence(F.lit(0), ((n - 3) / 2).cast("int")), span))
                           .otherwise(F.array().cast(kind))).drop("_pieces", "_size", "_blocks", "_before")


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    """The check that a base match of the kind must pass."""
    n = F.length(digits_of(found))
    if kind == "ip":
        # leading zeros do not make a part larger
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits_of(found))).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def features(kind: str, span: Column) -> Column:
    """Bins of the format and surroundings of a candidate, as a struct."""
    found, before, after = span["found"], span["before"], span["after"]
    n = F.length(digits_of(found))
    flag = lambda c: c.cast("int")
    return F.struct(
        F.when(F.lit(kind == "email"), F.lit(0)).otherwise(F.least(n, F.lit(20))).alias("digits"),
        F.least(F.size(F.split(found, "[^A-Za-z0-9]+")), F.lit(7)).alias("groups"),
        F.least(F.length(F.regexp_replace(found, r"[^.]", "")), F.lit(4)).alias("dots"),
        flag(found.startswith("+")).alias("plus"), flag(found.contains("(")).alias("bracket"),
        flag(found.rlike(r"^[0-9]{4}(?:([ -]?)[0-9]{4})(?:\1[0-9]{4}){2}$")).alias("even"),
        flag(valid(kind, found)).alias("check"), flag(before.rlike(ANNOUNCED[kind])).alias("announced"),
        flag(before.rlike(r"[\p{L}_=/.#:+-]$")).alias("after_letter"), flag(after.rlike(r"[\p{L}_=/@-]")).alias("before_letter"),
        flag(before.rlike(r"[0-9] ?$")).alias("after_digits"), flag(found.startswith("0")).alias("zero"),
        flag(found.rlike(r"(?i)[(\[](?:at|dot)[)\]]")).alias("spelled"))


def vote(kind: str, x: Column) -> tuple[Column, Column]:
    """(whether no base pattern can match the form, its label by voters or null)."""
    foreign = x["spelled"] == 1 if kind == "email" else x["plus"] == 0 if kind == "phone" else F.lit(False)
    clean = (x["after_letter"] == 0) & (x["before_letter"] == 0) & (x["after_digits"] == 0) & (x["check"] == 1)
    agreed = F.when(clean & (x["announced"] == 1), F.lit(1)).when(~clean & (x["announced"] == 0), F.lit(0))
    return foreign, F.when(foreign, agreed)


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, base, proposed): arrays of base spans and of candidates of each document."""
    docs = docs.select("doc_id", F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK + JOINT, STAND_IN * 2).alias("text"))
    docs = docs.withColumn("_digit", F.col("text").rlike("[0-9]")).withColumn("_at", F.col("text").rlike(r"@|[(\[](?i:at)[)\]]"))
    for i, kind in enumerate(KINDS):
        docs = with_kind(docs, i, kind, F.col("_at") if kind == "email" else F.col("_digit"))
    return docs.select("doc_id", F.array_sort(F.concat(*[f"_{k}" for k in KINDS])).alias("base"),
                       F.concat(*[f"_more_{k}" for k in KINDS]).alias("proposed"))


def with_kind(docs: DataFrame, i: int, kind: str, there: Column) -> DataFrame:
    """Adds the base spans and the candidates of one kind."""
    placed = lambda s: [s["first"].alias("first"), F.lit(i).alias("kind"), s["last"].alias("last")]
    docs = located(docs, f"_all_{kind}", BASE[kind], there, JOINTS.get(kind))
    docs = docs.withColumn(f"_{kind}", F.transform(F.filter(f"_all_{kind}", lambda s: valid(kind, s["found"])),
                                                   lambda s: F.struct(*placed(s))))
    # failed matches: a candidate inside a longer one was run over, so the pattern says nothing about it
    failed = F.filter(f"_all_{kind}", lambda s: ~valid(kind, s["found"]))
    docs = docs.withColumn(f"_failed_{kind}", F.transform(failed, lambda s: F.struct(*placed(s)))).drop(f"_all_{kind}")
    docs = located(docs, f"_more_{kind}", PROPOSED[kind], there, JOINTS["email"] if kind == "email" else None)

    def run_over(s: Column) -> Column:
        return F.exists(f"_failed_{kind}", lambda f: (f["first"] <= s["first"]) & (s["last"] <= f["last"])
                        & (f["last"] - f["first"] > s["last"] - s["first"]))

    docs = docs.withColumn(f"_found_{kind}", F.transform(
        f"_more_{kind}", lambda s: F.struct(*placed(s), features(kind, s).alias("x"), run_over(s).alias("over"))))

    def labelled(s: Column) -> Column:
        foreign, agreed = vote(kind, s["x"])
        return F.struct(s["first"], s["kind"], s["last"], s["x"], (foreign | s["over"]).alias("open"), agreed.alias("vote"))

    return docs.withColumn(f"_more_{kind}", F.transform(f"_found_{kind}", labelled))


def same(a: Column, b: Column) -> Column:
    return (a["first"] == b["first"]) & (a["kind"] == b["kind"]) & (a["last"] == b["last"])


def counted(found: DataFrame) -> list:
    """Candidates of all documents by kind, features and fold: how many, and how many are base spans."""
    rows = found.select((fold(F.col("doc_id"), FOLDS) == HELD).alias("held"), "base", F.explode("proposed").alias("c"))
    rows = rows.where(~F.col("c.open") | F.col("c.vote").isNotNull())
    label = F.coalesce(F.col("c.vote"), F.exists("base", lambda b: same(b, F.col("c"))).cast("int"))
    cells = rows.select("held", "c.kind", "c.x.*", label.alias("label"))
    # a row per combination of bins at most
    return cells.groupBy("held", "kind", *FEATURES).agg(F.count("*").alias("n"), F.sum("label").alias("hits")).collect()


class Trees:
    """Boosted regression trees of the logistic loss over counted cells; a node is (feature, bound, left, right)."""

    def __init__(self, x: np.ndarray, n: np.ndarray, hits: np.ndarray):
        self.bias = float(np.log((hits.sum() + 1) / (n.sum() - hits.sum() + 1)))
        self.trees = []
        z = np.full(len(x), self.bias)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(x, hits - n * p, n * p * (1 - p), DEPTH)
            self.trees.append(tree)
            z = z + self._value(tree, x)

    def _grow(self, x, slope, bend, depth):
        leaf = RATE * float(slope.sum() / (bend.sum() + 1))
        if depth == 0 or len(x) < 2:
            return leaf
        gain = lambda s, b: s * s / (b + 1)
        best = (1e-6, None, None)
        for f in range(x.shape[1]):
            for bound in np.unique(x[:, f])[:-1].tolist():
                left = x[:, f] <= bound
                now = (gain(slope[left].sum(), bend[left].sum()) + gain(slope[~left].sum(), bend[~left].sum())
                       - gain(slope.sum(), bend.sum()))
                if now > best[0]:
                    best = (now, f, bound)
        if best[1] is None:
            return leaf
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[left], slope[left], bend[left], depth - 1),
                self._grow(x[~left], slope[~left], bend[~left], depth - 1))

    def _value(self, node, x: np.ndarray) -> np.ndarray:
        if isinstance(node, float):
            return np.full(len(x), node)
        left = x[:, node[0]] <= node[1]
        return np.where(left, self._value(node[2], x), self._value(node[3], x))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._value(tree, x) for tree in self.trees)

    def column(self, kind: Column, bins: Column) -> Column:
        """The same sum as an expression."""
        names = ["kind", *FEATURES]

        def node(n) -> Column:
            if isinstance(n, float):
                return F.lit(n)
            value = kind if n[0] == 0 else bins[names[n[0]]]
            return F.when(value <= n[1], node(n[2])).otherwise(node(n[3]))

        return reduce(lambda a, b: a + b, [node(t) for t in self.trees], F.lit(self.bias))


def fit(found: DataFrame) -> tuple[Trees | None, dict[int, float]]:
    """Trees, and for each kind the lowest logit to accept; a kind without one accepts none."""
    cells = counted(found)
    train = sorted((c for c in cells if not c.held), key=tuple)
    if not train:
        return None, {}
    table_of = lambda rows: np.array([[c.kind, *(c[f] for f in FEATURES)] for c in rows], np.int64)
    trees = Trees(table_of(train), np.array([c.n for c in train], float), np.array([c.hits for c in train], float))
    bounds: dict[int, float] = {}
    for kind in range(len(KINDS)):
        # without rows held back the training rows stand in
        own = [c for c in cells if c.held and c.kind == kind] or [c for c in train if c.kind == kind]
        if own:
            z = trees.logits(table_of(own))
            order = np.argsort(-z, kind="stable")
            n, hits = np.cumsum([own[i].n for i in order]), np.cumsum([own[i].hits for i in order])
            last = np.append(z[order][1:] != z[order][:-1], True)
            good = np.flatnonzero(last & (hits >= TARGET * n) & ((n >= LEAST) | (hits == n)))
            if len(good):
                bounds[kind] = float(z[order][good[-1]])
    return trees, bounds


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (first, kind, last), sorted; ``spans`` holds base and added ones."""
    found = cut(detected(docs), "candidates")
    trees, bounds = fit(found)
    if not bounds:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    touch = lambda a, b: (a["first"] < b["last"]) & (b["first"] < a["last"])
    score = F.transform("proposed", lambda c: F.struct(
        c["first"].alias("first"), c["kind"].alias("kind"), c["last"].alias("last"), trees.column(c["kind"], c["x"]).alias("z")))

    def above(c: Column) -> Column:
        return reduce(lambda a, b: a | b, [(c["kind"] == k) & (c["z"] >= v - 1e-9) for k, v in bounds.items()])

    free = F.filter(score, lambda c: above(c) & ~F.exists("base", lambda b: touch(b, c)))
    rows = found.withColumn("_free", free)
    # of touching candidates the best score stays, then the longer, the earlier, the first kind
    worth = lambda c: F.struct(c["z"], c["last"] - c["first"], -c["first"], -c["kind"])
    best = F.filter("_free", lambda c: ~F.exists("_free", lambda o: touch(o, c) & (worth(o) > worth(c))))
    plain = F.transform(best, lambda c: F.struct(c["first"].alias("first"), c["kind"].alias("kind"), c["last"].alias("last")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", plain)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts without null, every span replaced by its kind in brackets."""
    spans = personal_spans(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text"))
    text, names = F.coalesce(F.col("doc_id.text"), F.lit("")), F.array(*[F.lit(f"[{k}]") for k in KINDS])
    # from the last span to the first, so that places before stay right; a span inside a redacted one is part of it
    out = F.aggregate(F.reverse("spans"), F.struct(text.alias("text"), F.length(text).cast("long").alias("end")), lambda s, x: F.struct(
        F.concat(F.substr(s["text"], F.lit(1), x["first"].cast("int")), F.get(names, x["kind"]),
                 F.substr(s["text"], F.least(x["last"], s["end"]).cast("int") + 1)).alias("text"), x["first"].alias("end")))
    return spans.select(F.col("doc_id.doc_id").alias("doc_id"), out["text"].alias("text"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(table(spark, sf_dir, "documents"))


def span_digests(docs: DataFrame) -> DataFrame:
    found = personal_spans(docs)
    count = lambda i: F.size(F.filter("base", lambda b: b["kind"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
