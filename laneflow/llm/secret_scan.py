"""Secrets: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

A run of token characters is a secret if the model of random strings makes it
likelier, per character, than the model of identifiers by more than a margin
learned from labelled strings; what lies beside fixed patterns and the parts of a
run between separators count as well. Native functions only: a pattern's matches are
framed with control characters, and the lengths of the pieces give their places.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.llm.base import fresh, hash_sample, once

# Fixed patterns. Each is (regular expression, replacement with frames, least length of the value).
KINDS: dict[str, tuple[str, str, int]] = {
    "assign": (
        r"((?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)",
        "\x01$1\x03$2\x02", 6,
    ),
    "access": (r"(AKIA[A-Z0-9]+)", "\x01\x03$1\x02", 20),
    # Runs below the least length would be dropped anyway and are not framed.
    "hex": (r"([0-9a-f]{24,})", "\x01\x03$1\x02", 24),
}
RANDOM = "markov"
RUN = r"([A-Za-z0-9+/_-]{20,}={0,2})"
# A run is parted at each separator alone, as the others may belong to a secret's alphabet, and at all of them.
SEPARATORS = ("/", "_", "-", "[+]", "[+/_-]")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,text:string>>"


def matches(text: Column, kind: str, rank: int, pattern: str, frame: str, keep) -> Column:
    """Spans of the leftmost non-overlapping matches whose value passes `keep`; places count code points.

    The text's own frame characters become another control character first,
    which no pattern matches, so places stay right.
    """
    clean = F.translate(text, "\x01\x02\x03", "\x04\x04\x04")
    pieces = F.split(F.regexp_replace(clean, pattern, frame), "\x01")

    def spans(parts: Column) -> Column:
        def step(acc: Column, part: Column) -> Column:
            framed = F.substring_index(part, "\x02", 1)  # head, mark, value
            length = F.length(framed) - 1
            value = F.substring_index(framed, "\x03", -1)
            found = F.array(F.struct(
                acc["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                (acc["at"] + length).alias("end"), value.alias("text"),
            )).cast(SPAN)
            return F.struct(
                (acc["at"] + F.length(part) - 2).alias("at"),
                F.when(keep(value), F.concat(acc["spans"], found)).otherwise(acc["spans"]).alias("spans"),
            )

        start = F.struct(
            F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(SPAN).alias("spans")
        )
        return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda a: a["spans"])

    # Most texts have no match: they skip the framing.
    return F.when(text.rlike(pattern), once(pieces, spans)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    found = [
        matches(text, kind, rank, pattern, frame, _at_least(least))
        for rank, (kind, (pattern, frame, least)) in enumerate(KINDS.items())
    ]
    return F.array_sort(F.concat(*found))


def _at_least(least: int):
    return lambda value: F.length(value) >= least


class Models(NamedTuple):
    """Log-likelihood ratios of character pairs, random over identifier, row by row, and the margin per character."""

    ratios: list[float]
    margin: float


def ratio(text: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the pairs of neighbouring characters; both ends count as a pair with no character."""
    size = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(repr(round(r, 6)) for r in ratios)), ",").cast("array<double>")
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    summed = F.aggregate(
        codes,
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.get(table, a["last"] * size + c)).alias("sum")),
        lambda a: a["sum"],
    )
    return summed / F.greatest(F.length(text), F.lit(1))


def random_strings(spark, count: int) -> DataFrame:
    """Labelled random strings: digests written in hexadecimal, base64, and in letters and digits of one or both cases."""
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    plain = F.regexp_replace(coded, "[+/=]", "")
    form = F.element_at(
        F.array(digest, F.substring(digest, 1, 40), coded, plain, F.upper(plain), F.regexp_replace(coded, r"\+", "_")),
        (F.pmod("id", F.lit(6)) + 1).cast("int"),
    )
    return spark.range(count).select(form.alias("string"), F.lit(1).alias("random"))


def identifiers(docs: DataFrame, documents: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    """Labelled identifiers: words of the corpus, alone and joined to names in the usual ways.

    From `documents` documents of at most `longest` bytes, chosen by a hash of
    id and text; words inside base secrets are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.octet_length("text").between(1, longest)
    )
    clean = hash_sample(rows, rows.count(), documents, "id", "text").select("text")
    for pattern, _, _ in KINDS.values():
        clean = clean.withColumn("text", F.regexp_replace("text", pattern, " "))
    # Words of letters; what mixes digits and letters may be an unlabelled secret.
    words = clean.select(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?![A-Za-z0-9+/_=-])"), F.lit(0)).alias("w"))
    word = lambda i, d: F.coalesce(F.get("w", i + d), F.lit("id"))
    names = words.select(F.explode(F.transform("w", lambda x, i: F.element_at(
        F.array(
            x, F.lower(x), F.upper(F.concat_ws("_", x, word(i, 1))),
            F.lower(F.concat_ws("_", x, word(i, 1), word(i, 2))),
            F.lower(F.concat_ws("-", x, word(i, 1), word(i, 2))),
            F.concat(F.lower(x), F.initcap(word(i, 1)), F.initcap(word(i, 2))),
            F.concat(F.initcap(x), F.initcap(word(i, 1)), F.lit("2")),
            F.lower(F.concat_ws("/", x, word(i, 1), word(i, 2))),
        ), F.pmod(i, F.lit(8)) + 1))).alias("string"))
    return names.select("string", F.lit(0).alias("random"))


def train(labelled: DataFrame, margin: float | None = None) -> Models:
    """Models from labelled strings (string, random 0 or 1), with add-one counts of character pairs.

    The margin is halfway between the highest ratio that identifiers of at
    least 20 characters reach (all but one in 10,000) and the lowest of random
    strings (all but one in 100), never below 0. At most (alphabet + 1)^2 counts
    of either class reach the driver.
    """
    size = len(ALPHABET) + 1
    pairs = labelled.where(F.length("string") > 0).select("random", F.explode(
        F.transform(F.split("string", ""), lambda c, i: F.struct(
            F.when(i > 0, F.instr(F.lit(ALPHABET), F.substring("string", i, F.lit(1)))).otherwise(0).alias("a"),
            F.instr(F.lit(ALPHABET), c).alias("b")))).alias("p"))
    counts = {0: [0] * size**2, 1: [0] * size**2}
    for r in pairs.groupBy("random", "p.a", "p.b").count().collect():
        counts[r["random"]][r["a"] * size + r["b"]] += r["count"]
    ratios = [0.0] * size**2
    for a in range(size):
        row = {k: counts[k][a * size : (a + 1) * size] for k in (0, 1)}
        for b in range(size):
            logs = [math.log((row[k][b] + 1) / (sum(row[k]) + size)) for k in (0, 1)]
            ratios[a * size + b] = logs[1] - logs[0]
    if margin is None:
        value = ratio(F.col("string"), ratios)
        seen = labelled.where(F.length("string") >= 20).select("random", value.alias("v")).groupBy("random").agg(
            F.expr("percentile_approx(v, array(0.01, 0.9999), 100000)").alias("q")).collect()
        found = {r["random"]: r["q"] for r in seen}
        low, high = found.get(0, [0.0, 0.0])[1], found.get(1, [0.0, 0.0])[0]
        margin = max(0.0, (low + high) / 2)
    return Models(ratios, margin)


def learn(
    docs: DataFrame, strings: int = 6000, documents: int = 2000, longest: int = 20_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> Models:
    """Models from `strings` random strings and the identifiers of `documents` documents: a bounded labelled sample."""
    return train(
        random_strings(docs.sparkSession, strings)
        .unionByName(identifiers(docs, documents, longest, id_col, text_col))
    )


def scan(docs: DataFrame, models: Models, text_col: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with `out`: the spans (start, rank, kind, end, text) of all secrets by start, then kind.

    Places are code points, the end exclusive. Kinds: assign, access, hex, and
    markov for what base spans leave of a run of token characters: each rest of
    20 or more with a digit and a letter, or in both cases, that passes the
    margin as a whole, else those of its parts between separators that do. Null
    texts count as empty and have none. Every column of `docs` stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mixed = lambda v: (v.rlike("[0-9]") & v.rlike("[A-Za-z]")) | (v.rlike("[a-z]") & v.rlike("[A-Z]"))
    keep = lambda v: v.rlike(f"^{RUN}$") & mixed(v) & (ratio(v, models.ratios) > models.margin)
    runs = matches(text, RANDOM, len(KINDS), RUN, "\x01\x03$1\x02", mixed)

    def secrets(rest: Column) -> Column:
        parts = F.concat(*[
            F.when(rest["text"].rlike(s), F.filter(parted(rest, s), lambda p: keep(p["text"]))).otherwise(F.array().cast(SPAN))
            for s in SEPARATORS
        ])
        some = F.when(rest["text"].rlike("[+/_-]"), once(parts, lambda p: united(rest, p))).otherwise(F.array().cast(SPAN))
        return F.when(keep(rest["text"]), F.array(rest)).otherwise(some)

    def both(base: Column) -> Column:
        rests = F.flatten(F.transform(runs, lambda r: cleared(r, base)))
        return F.array_sort(F.concat(base, F.flatten(F.transform(rests, secrets))))

    return docs.withColumn(out, once(base_spans(text), both))


def stretch(of: Column, start: Column, end: Column) -> Column:
    """The span from `start` to `end` within the span `of`."""
    return F.struct(
        start.cast("int").alias("start"), of["rank"].alias("rank"), of["kind"].alias("kind"), end.cast("int").alias("end"),
        F.substring(of["text"], start - of["start"] + 1, end - start).alias("text"),
    )


def cleared(run: Column, base: Column) -> Column:
    """What the base spans, sorted by start, leave of a run."""
    near = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))

    def cut(spans: Column) -> Column:
        add = lambda a, end: F.when(
            end > a["at"], F.concat(a["spans"], F.array(stretch(run, a["at"], end)).cast(SPAN))
        ).otherwise(a["spans"])
        return F.aggregate(
            spans,
            F.struct(run["start"].alias("at"), F.array().cast(SPAN).alias("spans")),
            lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), add(a, b["start"]).alias("spans")),
            lambda a: add(a, run["end"]),
        )

    return once(near, lambda n: F.when(F.size(n) > 0, cut(n)).otherwise(F.array(run)))


def parted(span: Column, separator: str) -> Column:
    """The parts of a span between the separators."""
    return F.aggregate(
        F.split(span["text"], separator),
        F.struct(span["start"].alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p) + 1).alias("at"),
            F.when(F.length(p) >= 20, F.concat(
                a["spans"], F.array(stretch(span, a["at"], a["at"] + F.length(p))).cast(SPAN)
            )).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )


def united(span: Column, parts: Column) -> Column:
    """Parts of a span, those that overlap made one."""
    return F.aggregate(
        F.array_sort(parts),
        F.array().cast(SPAN),
        lambda a, p: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["end"] > p["start"]),
            F.concat(
                F.slice(a, 1, F.size(a) - 1),
                F.array(stretch(
                    span, F.element_at(a, -1)["start"], F.greatest(F.element_at(a, -1)["end"], p["end"])
                )).cast(SPAN),
            ),
        ).otherwise(F.concat(a, F.array(p))),
    )


def written(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch of spans replaced by one mark; overlapping spans are one stretch."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """`docs`, in its columns, with its secrets masked; `n_chars`, where it is a column, follows the text.

    Every row stays: null and empty texts as they are, repeated rows each with
    the same masks, whatever their ids. Spans that overlap or touch the same
    place are one mask. Whole texts are masked, however long. Other columns pass
    unchanged, and an empty table gives an empty result.
    """
    spans = fresh(docs, "_secret_spans")
    found = scan(docs, models, text_col, spans)
    text = fresh(found, "_masked")
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns[text_col] = F.col(text)
    if "n_chars" in columns:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars"))
    return found.withColumn(text, masked(F.col(text_col), F.col(spans))).select(
        *[c.alias(n) for n, c in columns.items()]
    )
