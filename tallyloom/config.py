"""Settings of an analysis run, with the batch and the interactive profile."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The column names, labels and missing-value spellings that results must share
# with the tool this library stands in for.
REQUIRED_COLUMNS = ("date", "amount", "description")
TEXT_COLUMNS = ("merchant", "description", "notes")
DUPLICATE_KEY = ("date", "amount", "merchant", "description")
REVIEW_COLUMNS = (
    "date",
    "amount",
    "merchant",
    "description",
    "category_llm",
    "anomaly_reasons_rule",
    "suspicious_llm",
    "confidence_llm",
)
LABELS = (
    "Travel",
    "Meals",
    "Software",
    "Utilities",
    "Office Supplies",
    "Salary",
    "Miscellaneous",
    "Other",
)
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# The date formats a ledger may vote for, and the shape of a text that can be read by each.
DATE_SHAPES = {
    "yyyy-MM-dd": r"\d{4}-\d\d-\d\d",
    "yyyy/MM/dd": r"\d{4}/\d\d/\d\d",
    "yyyyMMdd": r"\d{8}",
    "M/d/yyyy": r"\d\d?/\d\d?/\d{4}",
    "d/M/yyyy": r"\d\d?/\d\d?/\d{4}",
    "M-d-yyyy": r"\d\d?-\d\d?-\d{4}",
    "d-M-yyyy": r"\d\d?-\d\d?-\d{4}",
    "d.M.yyyy": r"\d\d?\.\d\d?\.\d{4}",
    "d-MMM-yyyy": r"\d\d?-[A-Z][a-z]{2}-\d{4}",
    "d MMM yyyy": r"\d\d? [A-Z][a-z]{2} \d{4}",
    "MMM d, yyyy": r"[A-Z][a-z]{2} \d\d?, \d{4}",
    "yyyy-MM-dd HH:mm:ss": r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d",
    "yyyy-MM-dd'T'HH:mm:ss": r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d",
    "M/d/yyyy HH:mm": r"\d\d?/\d\d?/\d{4} \d\d:\d\d",
    "d/M/yyyy HH:mm": r"\d\d?/\d\d?/\d{4} \d\d:\d\d",
}


@dataclass(frozen=True)
class LedgerConfig:
    """Everything the two profiles, or a user, may set.

    ``date_formats``: the formats to try, in order; None lets the dates themselves vote for one of
    ``DATE_SHAPES``.
    ``on_classifier_error``: ``"raise"`` fails the job on a failed batch, ``"skip"`` leaves the
    rows of that batch without a prediction and keeps the error beside the batch.
    ``classifier_tries`` and ``classifier_wait``: calls per batch before it counts as failed, and the
    seconds before the second one; each wait is longer than the one before by as much.
    ``answer_log``: a folder in which answers are kept, so that a later run asks only for batches
    that have none; one folder per classifier.
    ``quantile_error``: the rank error, as a share of the rows, that the threshold may have; None
    for the exact threshold.
    ``percent_digits``: ``None`` keeps full precision, 1 rounds half to even.
    ``ordered_export``: sort exported rows by row key. Off by default, as it shuffles every row.
    """

    date_formats: tuple[str, ...] | None = None
    missing_text: str | None = "nan"
    quantile: float = 0.95
    quantile_error: float | None = None
    labels: tuple[str, ...] = LABELS
    strict_labels: bool = False
    batch_size: int = 20
    on_classifier_error: str = "raise"
    classifier_tasks: int | None = None
    classifier_tries: int = 3
    classifier_wait: float = 0.0
    answer_log: str | None = None
    percent_digits: int | None = None
    export_month: bool = False
    ordered_export: bool = False
    preview_rows: int = 5
    sample_rows: int = 10


BATCH = LedgerConfig()
INTERACTIVE = replace(
    BATCH,
    batch_size=10,
    on_classifier_error="skip",
    classifier_wait=10.0,
    percent_digits=1,
    export_month=True,
    preview_rows=20,
)
