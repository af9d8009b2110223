"""Text contexts: tokens, redaction, token ids and context sentences.  All work is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarf.functions.hashing import vocabulary_id
from swarf.functions.matching import literals
from swarf.operators.channels import compatibility_form
from swarf.rules import text as rules

# Characters outside this set may change under compatibility normalisation.
PLAIN = r"[^\x00-\x7FÀ-ÖØ-öø-ÿ가-힣]"


def compatible(text: Column) -> Column:
    """NFKC form; only texts holding other than plain characters travel to Python."""
    return F.coalesce(compatibility_form(F.when(text.rlike(PLAIN), text)), text)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rules.TOKEN_PATTERN), F.lit(0))


def _allowed(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~F.array_contains(literals(rules.BLOCKED_WORDS), w))


def _safe(text: Column) -> Column:
    return F.array_join(_allowed(_tokens(text)), " ")


def tokenize(docs: DataFrame, column: str = "text", output: str = "tokens") -> DataFrame:
    """Lower-case alphanumeric and Hangul tokens of the whole text; accented letters separate tokens."""
    return docs.withColumn(output, _tokens(compatible(F.col(column))))


def redact_tokens(docs: DataFrame, tokens: str = "tokens", output: str = "redacted") -> DataFrame:
    """Drop label-leaking tokens, keep order and repeats, join by blanks."""
    return docs.withColumn(output, F.array_join(_allowed(F.col(tokens)), " "))


def encode_tokens(docs: DataFrame, tokens: str = "tokens", length: int | None = None, vocabulary: int = rules.VOCABULARY) -> DataFrame:
    """Stable ids of all tokens and their mask; with ``length``, a row of so many, cut or zero-padded."""
    head = F.col(tokens) if length is None else F.slice(tokens, 1, length)
    gap = F.lit(0) if length is None else F.greatest(F.lit(0), F.lit(length) - F.size(head))
    ids = F.transform(head, lambda w: vocabulary_id(w, vocabulary))
    return docs.withColumns(
        {
            "text_ids": F.concat(ids, F.array_repeat(F.lit(0).cast("long"), gap)),
            "text_mask": F.concat(F.transform(head, lambda w: F.lit(True)), F.array_repeat(F.lit(False), gap)),
        }
    )


def path_context(files: DataFrame, path: str = "file_path", output: str = "path_context") -> DataFrame:
    """Operation words, machine / operation / tool marks and materials named by the path parts."""

    def words(part: Column) -> Column:
        named = lambda pattern, label: F.when(part.rlike(f"^{pattern}$"), F.concat(F.lit(label + " "), part))
        marks = F.array(
            F.when(F.array_contains(literals(rules.OPERATION_WORDS), part), part),
            named(r"m\d+", "machine"), named(r"op\d+", "operation"), named(r"t\d+", "tool"),
        )
        run = lambda g: F.regexp_extract(part, r"\bm(\d+)t(\d+)r(\d+)", g)
        triple = F.when(
            run(1) != "", F.array(F.concat(F.lit("machine m"), run(1)), F.concat(F.lit("tool t"), run(2)), F.concat(F.lit("run r"), run(3)))
        ).otherwise(F.expr("cast(array() AS array<string>)"))
        materials = [F.regexp_extract_all(part, F.lit(p), F.lit(0)) for p in rules.MATERIAL_PATTERNS]
        return F.concat(F.array_compact(marks), *materials, triple)

    clean = lambda p: F.trim(F.regexp_replace(F.lower(p), rules.SEPARATOR_PATTERN, "_"), F.lit("_"))
    parts = F.filter(F.transform(F.split(path, "/"), clean), lambda p: p != "")
    return files.withColumn("_parts", parts).withColumn(
        output, F.coalesce(_safe(F.array_join(F.flatten(F.transform("_parts", words)), " ")), F.lit(""))
    ).drop("_parts")


def condition_text(conditions: Column, sanitize: bool) -> Column:
    """``process conditions k v …`` over the sorted non-empty entries, or an empty text."""
    kept = F.filter(F.array_sort(F.map_entries(conditions)), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    joined = F.array_join(F.transform(kept, lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
    text = F.when(F.size(kept) > 0, F.concat(F.lit("process conditions "), joined)).otherwise("")
    return _safe(text) if sanitize else text


def _present(text: Column) -> Column:
    return F.when(text != "", text)


def record_context(records: DataFrame, conditions: str, quantities: str, sources: str) -> DataFrame:
    """Sanitised sentence of a manifest record for pretraining; blocked words never survive."""
    parts = [F.lit(rules.SAMPLE_PREFIX)]
    dataset = _safe(F.coalesce("dataset_id", F.lit("")))
    parts.append(F.when(dataset != "", F.concat(F.lit("dataset "), dataset)))
    for key in rules.RECORD_KEYS:
        if key in records.columns:
            value = F.col(key).cast("string")
            parts.append(F.when(value != "", F.concat(F.lit(key.replace("_", " ") + " "), value)))
    with_path = path_context(records, output="_path")
    parts.append(_present(F.col("_path")))
    parts.append(_present(condition_text(F.col(conditions), True)))
    for label, column in (("sensor quantities ", quantities), ("sensor sources ", sources)):
        names = F.array_join(F.array_sort(F.array_distinct(column)), " ")
        parts.append(F.when(names != "", F.concat(F.lit(label), names)))
    return with_path.withColumn("text_context", _safe(F.concat_ws(" ", *parts))).drop("_path")


def request_context(requests: DataFrame, conditions: str, sensors: str) -> DataFrame:
    """Labelled, unsanitised sentence of a prediction request."""
    parts = []
    for column, label in rules.REQUEST_FIELDS:
        if column in requests.columns:
            value = F.col(column).cast("string")
            parts.append(F.when(value != "", F.concat(F.lit(label + ": "), value)))
    parts.append(_present(condition_text(F.col(conditions), False)))
    names = F.array_join(sensors, " ")
    parts.append(F.when(names != "", F.concat(F.lit("sensors: "), names)))
    return requests.withColumn("request_context", F.trim(F.concat_ws(" ", *parts)))
