"""Personal data by weak supervision, in SQL functions only.

Patterns propose spans; for each span labelers vote for (1), against (-1) or abstain (0): the strict form of the
value, a gazetteer, words before it that name such data, and words that name something else. The votes of
all documents are counted per kind and pattern (at most ``KINDS`` x 3^4 rows, which go to the driver),
expectation-maximisation estimates each labeler's reliability there, and a logistic span classifier is trained on its
posteriors. The classifier decides which spans of the extra kinds are added; spans of the base kinds always stay.

Defined cases: a null text is empty; repeated rows give a row each; null ids are kept; overlapping
spans of different kinds all count; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import TEXT_ROWS, few_files, land

# Fixed patterns. Possessive repeats match the same strings as greedy ones here and need no stack.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|api_key|secret)\x20?[=:]\x20?\S++)|\b[0-9a-f]{40}\b"
#: kind, pattern, characters one of which every match holds.
KINDS = (
    ("email", EMAIL, "[@]"),
    ("ip", IP, "[0-9]"),
    ("card", CARD, "[0-9]"),
    ("phone", PHONE, "[+]"),
    ("secret", SECRET, "AKIA|[=:]|[0-9a-f]{40}"),
)
BASE = ("email", "ip", "card", "phone")
NAMES = [kind for kind, _, _ in KINDS]
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu"]
NAMING = {
    "email": "(?i)mail|contact|write to|@",
    "ip": "(?i)\\bip\\b|address|server|host|login|from",
    "card": "(?i)card|visa|master|credit|payment|account",
    "phone": "(?i)phone|call|tel|mobile|fax|contact",
    "secret": "(?i)key|secret|token|password|credential|[\"'=:]$",
}
OTHER_NAMING = "(?i)(?:isbn|version|section|figure|commit|checksum|example|\\bv)[\\s.:#]*$"
BEFORE, AFTER = 32, 8


def spans_of(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost matches with the text lengths between them: array of (value, gap, before)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    spans = F.zip_with(
        found,
        between,
        lambda value, gap: F.struct(value.alias("value"), F.char_length(gap).alias("gap"), F.right(gap, F.lit(BEFORE)).alias("before")),
    )
    # The split has one part more than there are matches; that last pair has no value.
    spans = F.filter(spans, lambda one: one["value"].isNotNull())
    return F.when(text.rlike(needs) & text.rlike(pattern), spans)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the check sum."""
    figures = F.split(F.reverse(digits(value)), "")
    doubled = F.transform(
        figures, lambda one, at: F.when(at % 2 == 0, one.cast("int")).otherwise(2 * one.cast("int") - F.when(one.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda total, one: total + F.coalesce(one, F.lit(0))) % 10 == 0


def passes() -> Column:
    """Whether a span meets the rule of its kind."""
    value, count = F.col("value"), F.length(digits(F.col("value")))
    parts = F.transform(F.split(value, "\\."), lambda one: F.regexp_replace(one, "^0+", ""))
    return (
        F.when(F.col("kind") == "ip", F.forall(parts, lambda one: (F.length(one) <= 3) & (F.lpad(one, 3, "0") <= "255")))
        .when(F.col("kind") == "card", count.between(16, 19) & luhn(value))
        .when(F.col("kind") == "phone", count.between(8, 15))
        .otherwise(True)
    )


def votes() -> dict[str, Column]:
    """The labelers."""
    kind, value, before = F.col("kind"), F.col("value"), F.col("before")

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    strict = (
        F.when(kind == "email", vote(value.rlike(r"^[^.][^@]*[^.@]@.+\.[A-Za-z]{2,}$"), value.rlike(r"\.\.")))
        .when(kind == "ip", vote(~value.rlike(r"^0|\.0[0-9]"), value.rlike(r"^0")))
        .when(kind == "card", vote(value.rlike("^[3-6]"), value.rlike("^0")))
        .when(kind == "phone", vote(value.rlike(r"^\+[1-9]"), value.rlike(r"^\+0")))
        .otherwise(vote(value.rlike("^AKIA|[0-9].*[a-f]|[a-f].*[0-9]"), value.rlike(r"[=:]\x20?[A-Za-z]{1,7}[.,]?$")))
    )
    last = F.lower(F.element_at(F.split(value, "\\."), -1))
    gazetteer = (
        F.when(kind == "email", vote(last.isin(TOP_DOMAINS), F.lit(False)))
        .when(kind == "ip", vote(value.rlike(r"^(?:10|127|172|192)\."), F.lit(False)))
        .when(kind == "card", vote(value.rlike("^(?:4|5[1-5]|34|37|6011)"), F.lit(False)))
        .when(kind == "phone", vote(value.rlike(r"^\+(?:1|33|34|44|49)\b"), F.lit(False)))
        .otherwise(vote(value.rlike("(?i)^(?:AKIA|password|passwd|api_key|secret)"), F.lit(False)))
    )
    named = F.lit(False)
    for name, words in NAMING.items():
        named = F.when(kind == name, before.rlike(words)).otherwise(named)
    return {
        "v_strict": strict,
        "v_gazetteer": gazetteer,
        "v_context": vote(named, F.lit(False)),
        "v_other": vote(F.lit(False), before.rlike(OTHER_NAMING)),
    }


VOTES = ("v_strict", "v_gazetteer", "v_context", "v_other")


def fit_label_model(counts: list[dict], rounds: int = 50) -> list[float]:
    """Posterior of each counted vote pattern, by expectation-maximisation.

    Each labeler has a share of yes, no and abstain votes among real and among false spans; shares
    start from the belief that a vote is right four times out of five.
    """
    share = {
        (name, vote, real): {1: 0.5, 0: 0.3, -1: 0.2}[vote if real else -vote] for name in VOTES for vote in (-1, 0, 1) for real in (True, False)
    }
    prior, posterior = 0.8, []
    for _ in range(rounds):
        posterior = []
        for row in counts:
            score = math.log(prior / (1 - prior)) + sum(
                math.log(share[name, row[name], True] / share[name, row[name], False]) for name in VOTES
            )
            posterior.append(1 / (1 + math.exp(-max(-30.0, min(30.0, score)))))
        total = sum(row["n"] for row in counts)
        real = sum(row["n"] * p for row, p in zip(counts, posterior, strict=True))
        prior = min(0.99, max(0.01, real / max(1, total)))
        for name in VOTES:
            for is_real, mass in ((True, real), (False, total - real)):
                for vote in (-1, 0, 1):
                    hit = sum(
                        row["n"] * (p if is_real else 1 - p) for row, p in zip(counts, posterior, strict=True) if row[name] == vote
                    )
                    start = {1: 0.5, 0: 0.3, -1: 0.2}[vote if is_real else -vote]
                    # A weight of 20 spans for the starting belief keeps the two classes apart.
                    share[name, vote, is_real] = (hit + 20 * start) / (mass + 20)
    return posterior


def fit_classifier(counts: list[dict], posterior: list[float], rounds: int = 300) -> dict[str, float]:
    """Logistic regression on votes and kinds with the posteriors as soft labels."""
    names = ["bias", *VOTES, *(f"is_{kind}" for kind in NAMES)]
    total = max(1, sum(row["n"] for row in counts))
    weights = dict.fromkeys(names, 0.0)
    for _ in range(rounds):
        slope = dict.fromkeys(names, 0.0)
        for row, wanted in zip(counts, posterior, strict=True):
            inputs = {"bias": 1.0, f"is_{row['kind']}": 1.0} | {name: float(row[name]) for name in VOTES}
            score = sum(weights[name] * x for name, x in inputs.items())
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, score)))) - wanted
            for name, x in inputs.items():
                slope[name] += error * x * row["n"] / total
        for name in names:
            weights[name] -= slope[name] + 0.001 * weights[name]
    return weights


def candidates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A landed row per document row: row, doc_id, one array of matches per kind, and the columns to keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [spans_of(text, pattern, needs).alias(f"{kind}_matches") for kind, pattern, needs in KINDS]
    kept = F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), kept, *columns)
    return land(found.withColumn("row", F.monotonically_increasing_id()), "candidates")


def place_spans(landed: DataFrame) -> DataFrame:
    """Candidate spans with their places, rules and votes applied."""
    placed = None
    for at, (kind, _, _) in enumerate(KINDS):
        matches = f"{kind}_matches"
        one = landed.where(F.size(matches) > 0).select(
            "row", F.lit(at).alias("order"), F.lit(kind).alias("kind"), F.posexplode(matches).alias("nth", "one")
        )
        one = one.select("row", "order", "kind", "nth", "one.value", "one.gap", "one.before")
        placed = one if placed is None else placed.unionByName(one)
    # Ends are running sums of gaps and values along the matches of one text.
    along = Window.partitionBy("row", "order").orderBy("nth")
    end = F.sum(F.col("gap") + F.char_length("value")).over(along)
    placed = placed.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("value"))
    return placed.drop("nth", "gap").where(passes()).withColumns(votes())


def detect(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (array), kept columns."""
    landed = candidates(docs, keep)
    placed = land(few_files(place_spans(landed), landed.count(), TEXT_ROWS), "spans")
    counts = [
        row.asDict() for row in placed.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).orderBy("kind", *VOTES).collect()
    ]
    weights = fit_classifier(counts, fit_label_model(counts))
    score = F.lit(weights["bias"])
    for name in VOTES:
        score = score + F.lit(weights[name]) * F.col(name)
    for kind in NAMES:
        score = score + F.when(F.col("kind") == kind, weights[f"is_{kind}"]).otherwise(0.0)
    chosen = placed.where(F.col("kind").isin(*BASE) | (score >= 0))
    label = F.concat_ws(":", "kind", "start", "end")
    spans = chosen.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("order", "start", "end", "kind", label.alias("label")))).alias("found")
    )
    joined = landed.select("row", "doc_id", "kept").join(spans, "row", "left")
    found = F.coalesce(F.col("found"), F.expr("cast(array() as array<struct<order:int,start:long,end:long,kind:string,label:string>>)"))
    joined = joined.withColumn("found", found)
    base = F.filter("found", lambda one: one["order"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda one: one["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda one: one["label"]), ",")

    return joined.select(
        "doc_id",
        *(count(kind) for kind in BASE),
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("found")).alias("spans"),
        "found",
        "kept",
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; ``n_chars`` follows the new text.

    Overlapping spans are replaced together, as the kind of the one that starts first (of these, the longest).
    """
    names = docs.columns
    judged = detect(docs, tuple(names))
    ordered = F.array_sort(
        F.transform("found", lambda one: F.struct(one["start"].alias("start"), (-one["end"]).alias("back"), one["kind"].alias("kind")))
    )
    merged = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("end")),
        lambda state, one: F.when(
            one["start"] >= state["end"],
            F.struct(
                F.concat(
                    state["text"],
                    F.substring("kept.text", state["end"].cast("int") + 1, (one["start"] - state["end"]).cast("int")),
                    F.concat(F.lit("["), F.upper(one["kind"]), F.lit("]")),
                ).alias("text"),
                (-one["back"]).alias("end"),
            ),
        ).otherwise(F.struct(state["text"].alias("text"), F.greatest(state["end"], -one["back"]).alias("end"))),
        lambda state: F.concat(
            state["text"], F.substring("kept.text", state["end"].cast("int") + 1, F.char_length("kept.text"))
        ),
    )
    changed = judged.withColumn("new_text", F.when(F.size("found") > 0, merged).otherwise(F.col("kept.text")))
    replaced = {"text": F.col("new_text")}
    if "n_chars" in names:
        length = F.char_length("new_text").cast(docs.schema["n_chars"].dataType)
        replaced["n_chars"] = F.when(F.size("found") > 0, length).otherwise(F.col("kept.n_chars"))
    return changed.select(*(replaced.get(name, F.col(f"kept.`{name}`")).alias(name) for name in names))
