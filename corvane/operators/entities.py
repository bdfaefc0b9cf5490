"""Entity tables: keys, coverage by source, quality status, index and the merged master table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import strip_long, text
from corvane.operators.skew import met
from corvane.sources.readers import ORDER
from corvane.staging import staged

# The modalities in their order of precedence, the key's names, and status words by rank.
MODALITIES = ("EEG", "fMRI", "DTI", "MRI", "scales")
KEY_NAMES = ("subject_id", "participant_id", "sub_id", "sub", "subject")
STATUSES = ("unknown", "pass", "caution", "fail")


def key_column(columns: Sequence[str], names: Sequence[str] = KEY_NAMES) -> str:
    """The first of the key's names among some columns."""
    for n in names:
        if n in columns:
            return n
    if not columns:
        return names[0]
    raise ValueError(f"none of the key columns {', '.join(names)} is in {', '.join(columns)}")


def with_order(df: DataFrame) -> DataFrame:
    return df if ORDER in df.columns else df.withColumn(ORDER, F.monotonically_increasing_id())


def normalized(df: DataFrame, names: Sequence[str] = KEY_NAMES) -> DataFrame:
    """df with a trimmed subject_id; rows without one go. A key under another name stays beside it."""
    key = key_column([c for c in df.columns if c != ORDER], names)
    return with_order(df).withColumn("subject_id", strip_long(F.col(f"`{key}`"))).filter(F.col("subject_id") != "")


def coverage(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """(subject_id, modality): which subjects each table holds."""
    out = None
    for modality, df in tables.items():
        own = df.select("subject_id", F.lit(modality).alias("modality")).distinct()
        out = own if out is None else out.unionByName(own)
    return out


def normalized_status(c: F.Column, passes: Sequence, cautions: Sequence, fails: Sequence) -> F.Column:
    """pass, caution, fail or unknown; values match exactly, after trimming, as their printed forms."""
    among = lambda values: strip_long(c).isin(*[str(v) for v in values]) if values else F.lit(False)
    return F.when(among(passes), "pass").when(among(cautions), "caution").when(among(fails), "fail").otherwise("unknown")


def qc_records(df: DataFrame, passes: Sequence, cautions: Sequence, fails: Sequence, names: Sequence[str] = KEY_NAMES) -> DataFrame:
    """One row for each quality record; a table without modalities holds for `all`."""
    rows = normalized(df, names)
    cell = lambda c, default: text(F.col(c)) if c in rows.columns else F.lit(default)
    empty = lambda c: F.nullif(cell(c, ""), F.lit(""))
    status = normalized_status(cell("qc_status", ""), passes, cautions, fails)
    return rows.select("subject_id", cell("modality", "all").alias("modality"), status.alias("qc_status"), *[empty(c).alias(c) for c in ("qc_metric", "qc_value", "reason")], ORDER)


def unknown_qc(subjects: DataFrame) -> DataFrame:
    """Records that stand in where there is no quality table."""
    none = F.lit(None).cast("string")
    return subjects.select("subject_id", F.lit("all").alias("modality"), F.lit("unknown").alias("qc_status"), none.alias("qc_metric"), none.alias("qc_value"), F.lit("QC file missing").alias("reason"), ORDER)


def overall_status(records: DataFrame) -> DataFrame:
    """The worst status of each subject: fail, caution, pass, then unknown."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("qc_status"))
    worst = records.groupBy("subject_id").agg(F.max(rank).alias("rank"))
    return worst.select("subject_id", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("rank").cast("int")).alias("overall_qc_status"))


def qc_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("modality", "qc_status").agg(F.count("*").alias("n"))


def index(subjects: DataFrame, covered: DataFrame, status: DataFrame, modalities: Sequence[str] = MODALITIES) -> DataFrame:
    """One row for each row of subjects: attributes, a flag for each modality, and the worst status."""
    flags = covered.groupBy("subject_id").agg(*[F.max(F.col("modality") == m).alias(f"has_{m}") for m in modalities])
    joined = subjects.join(flags, "subject_id", "left").join(status, "subject_id", "left")
    cell = lambda c: text(F.col(c)) if c in subjects.columns else F.lit("")
    has = {m: F.coalesce(F.col(f"`has_{m}`"), F.lit(False)) for m in modalities}
    age = F.col("age").try_cast("double") if "age" in subjects.columns else F.lit(None).cast("double")
    return joined.select(
        "subject_id",
        cell("group").alias("group"),
        age.alias("age"),
        cell("sex").alias("sex"),
        *[has[m].alias(f"has_{m}") for m in modalities],
        F.concat_ws(";", *[F.when(has[m], m) for m in modalities]).alias("available_modalities"),
        F.coalesce("overall_qc_status", F.lit("unknown")).alias("overall_qc_status"),
        cell("notes").alias("notes"),
        ORDER,
    )


def _stacked(subjects: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
    """Rows of all tables under one another with their table's rank, subjects first; all columns' names, and each table's."""
    own = [c for c in subjects.columns if c not in ("subject_id", ORDER)]
    each = lambda df, columns, rank: df.select("subject_id", *[text(F.col(f"`{c}`")).alias(c) for c in columns], F.lit(rank).alias("__rank"), ORDER)
    stack, names, within = each(subjects, own, 0), list(own), {}
    for rank, (modality, df) in enumerate(tables.items(), 1):
        within[modality] = [c for c in df.columns if c not in ("subject_id", ORDER)]
        names += [c for c in within[modality] if c not in names]
        stack = stack.unionByName(each(df, within[modality], rank), allowMissingColumns=True)
    return stack, names, within


def cells(stack: DataFrame, names: Sequence[str], own: Sequence[str], within: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row for each subject of a stack: a base value for each column, each table's first values that conflict with it
    (in __0_<i>), and whether a table holds the subject more than once (__many).

    The last row of the subjects and the first of each table tell all that, each as one value, so the group has a few aggregates
    however many columns there are. They merge: rows are combined before the one shuffle and a subject with many rows meets in no task.
    """
    cell = lambda c: F.col(f"`{c}`")
    whole = lambda columns: F.struct(*[cell(c).alias(f"c{i}") for i, c in enumerate(columns)])
    tables = {rank: columns for rank, columns in enumerate(within.values(), 1) if columns}
    told = [F.count_if(F.col("__rank") == rank).alias(f"__n_{rank}") for rank in tables]
    told += [F.min_by(whole(columns), F.when(F.col("__rank") == rank, F.struct(ORDER))).alias(f"__t_{rank}") for rank, columns in tables.items()]
    if own:
        told.append(F.max_by(whole(own), F.when(F.col("__rank") == 0, F.col(ORDER))).alias("__t_0"))
    grouped = stack.groupBy("subject_id").agg(F.count("*").alias("__rows"), F.min(F.struct("__rank", ORDER)).alias("__at"), *told)
    # A cell is null only where the table lacks the subject or the column.
    places: dict[str, list[Column]] = {c: [] for c in names}
    for rank, columns in [*([(0, own)] if own else []), *tables.items()]:
        for i, c in enumerate(columns):
            places[c].append(F.col(f"__t_{rank}.c{i}"))
    base = grouped.select("*", *[F.coalesce(*places[c]).alias(f"__b_{c}") for c in names])
    later = [(c, F.col(f"__t_{rank}.c{i}")) for rank, columns in tables.items() for i, c in enumerate(columns)]
    differ = [F.when((value != "") & (value != F.col(f"`__b_{c}`")), value).alias(f"__0_{i}") for i, (c, value) in enumerate(later)]
    many = reduce(Column.__or__, [F.col(f"__n_{rank}") > 1 for rank in tables], F.lit(False)).alias("__many")
    return base.select("subject_id", "__rows", "__at", many, *[F.col(f"`__b_{c}`") for c in names], *differ)


def merged(subjects: DataFrame, tables: Mapping[str, DataFrame], conflicts: str = "found") -> tuple[DataFrame, DataFrame]:
    """Full outer merge of tables onto subjects by subject_id, and a log of conflicts.

    A cell keeps the value written first, in the order of subjects and then tables, even if that is empty; a later
    value of a table that differs and isn't empty goes to <modality>_<column>, where the last one stays. Of
    subjects that repeat among `subjects` the last row counts, at the first one's place. Cells that no table has are
    empty. conflicts: `found` makes columns only for conflicts there are; `all` makes every possible one; `none` makes none
    and runs nothing.

    All tables are stacked and grouped once, into a table that is written: cells() tells the conflicts of subjects that are in
    each table once. Subjects that a table repeats, if there are any, have their rows read again and held against the base; a
    subject with a large share of them gets its base by broadcast.
    """
    stack, names, within = _stacked(subjects, tables)
    renamed = [(m, c) for m, columns in within.items() for c in columns]
    own = [c for c in subjects.columns if c not in ("subject_id", ORDER)]
    clash = [f"{m}_{c}" for m, c in renamed if f"{m}_{c}" in names]
    if clash and conflicts != "none":
        raise ValueError(f"columns {', '.join(clash)} have the names that conflicts would take")
    if conflicts == "none":
        renamed = []
    out, log = cells(stack, names, own, within), []
    if renamed:
        out = staged(out, "merge-cells")
        found = _conflicts(stack, out, renamed, within)
        if conflicts == "found":
            counts = found.agg(*[F.sum(f"__n_{i}") for i in range(len(renamed))]).first()
            there = [i for i, n in enumerate(counts) if n]
            log = [(renamed[i][1], f"{renamed[i][0]}_{renamed[i][1]}", renamed[i][0], counts[i]) for i in there]
        else:
            there = list(range(len(renamed)))
    else:
        found, there = out, []
    name = lambda i: f"{renamed[i][0]}_{renamed[i][1]}"
    table = found.select(
        "subject_id",
        *[text(F.col(f"`__b_{c}`")).alias(c) for c in names],
        *[text(F.col(f"__v_{i}")).alias(name(i)) for i in there],
        F.col("__at").alias(ORDER),
    )
    if conflicts != "all" or not there:
        return table, subjects.sparkSession.createDataFrame(log, "column string, renamed_to string, modality string, n long")
    entries = [F.struct(F.lit(renamed[i][1]).alias("column"), F.lit(name(i)).alias("renamed_to"), F.lit(renamed[i][0]).alias("modality"), F.col(f"__n_{i}").alias("n")) for i in there]
    return table, found.select(F.inline(F.array(*entries))).filter("n > 0").groupBy("column", "renamed_to", "modality").agg(F.sum("n").alias("n"))


def _conflicts(stack: DataFrame, grouped: DataFrame, renamed: Sequence[tuple[str, str]], within: Mapping[str, Sequence[str]]) -> DataFrame:
    """grouped rows with, for each possible conflict, the last value that differs from the base (__v_) and how many do (__n_)."""
    b = lambda c: F.col(f"`__b_{c}`")
    keep = [F.col(f"`{c}`") for c in grouped.columns if c != "__many" and not c.startswith("__0_")]
    values = [x for i in range(len(renamed)) for x in (F.col(f"__0_{i}").alias(f"__v_{i}"), F.col(f"__0_{i}").isNotNull().cast("bigint").alias(f"__n_{i}"))]
    # Of a table's several rows the first doesn't tell the later values.
    clear = grouped.filter("NOT __many").select(*keep, *values)
    open_ = grouped.filter("__many").select(*keep)
    rows = open_.agg(F.sum("__rows")).first()[0]
    if not rows:
        return clear
    again = met(stack.filter("__rank > 0"), open_.drop("__at"), ["subject_id"], F.col("__rows"), rows)
    rank = {m: i for i, m in enumerate(within, 1)}
    later = []
    for i, (m, c) in enumerate(renamed):
        differs = (F.col("__rank") == rank[m]) & (F.col(f"`{c}`") != b(c)) & (F.col(f"`{c}`") != "")
        later += [F.max_by(F.col(f"`{c}`"), F.when(differs, F.col(ORDER))).alias(f"__v_{i}"), F.count_if(differs).alias(f"__n_{i}")]
    return clear.unionByName(open_.join(again.groupBy("subject_id").agg(*later), "subject_id"))
