"""Evaluation metrics as aggregates: counts first, ratios from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.operators.windows import running_sum


def ratio(a, b, empty: float = 0.0) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, F.lit(empty)).otherwise(a.cast("double") / b)


def confusion_columns(truth: Column, pred: Column) -> list[Column]:
    """tp, fp, fn, tn over two boolean columns."""
    return [F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"),
            F.count_if(truth & ~pred).alias("fn"), F.count_if(~truth & ~pred).alias("tn")]


def confusion(df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*confusion_columns(truth, pred))


def prf_columns(empty_precision: float = 0.0, scale: float = 1.0) -> list[Column]:
    """precision, recall, f1 and accuracy from tp, fp, fn, tn; precision when nothing is
    predicted is an argument, because the two evaluations differ in it."""
    p = ratio("tp", F.col("tp") + F.col("fp"), empty_precision)
    r = ratio("tp", F.col("tp") + F.col("fn"))
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    acc = ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return [(c * scale).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f1, "f1"), (acc, "accuracy"))]


def prf(counts: DataFrame, empty_precision: float = 0.0, scale: float = 1.0) -> DataFrame:
    return counts.select("*", *prf_columns(empty_precision, scale))


def specificity() -> Column:
    return ratio("tn", F.col("tn") + F.col("fp"))


def balanced_accuracy() -> Column:
    return (ratio("tp", F.col("tp") + F.col("fn")) + specificity()) / 2


def compare_runs(truth: DataFrame, tool: DataFrame, project: str = "project", key: str = "flow_hash",
                 label: str = "label", position: str = "position") -> DataFrame:
    """Metrics of a tool's labels and of mere presence, per project and over all.

    Of flows with one key the last label counts.  A missing truth label is No, a missing tool
    label Yes, a flow the tool does not report No.  ``verdict`` compares the two f1 values.
    """
    def last(df, missing):
        value = F.coalesce(F.lower(F.col(label)), F.lit(missing))
        return df.groupBy(project, key).agg(F.max_by(value, position).alias("_l"))
    t = last(truth, "no").withColumnRenamed("_l", "_t")
    p = last(tool, "yes").withColumnRenamed("_l", "_p")
    compared = tool.select(project).distinct()
    j = t.join(compared, project, "left_semi").join(p, [project, key], "left")
    yes, shown = F.col("_t") == "yes", F.col("_p").isNotNull()
    kept = F.coalesce(F.col("_p") == "yes", F.lit(False))
    counts = j.rollup(project).agg(
        *[c.alias(f"wv_{n}") for c, n in zip(_raw(yes, kept), _NAMES)],
        *[c.alias(f"nv_{n}") for c, n in zip(_raw(yes, shown), _NAMES)])
    out = counts
    for tag in ("wv", "nv"):
        renamed = out.select("*", *[F.col(f"{tag}_{n}").alias(n) for n in _NAMES])
        out = renamed.select(*out.columns, *[c.alias(f"{tag}_{n}") for c, n in zip(
            [*[x for x in prf_columns(1.0)], specificity(), balanced_accuracy()],
            ("precision", "recall", "f1", "accuracy", "specificity", "balanced_accuracy"))])
    delta = F.col("wv_f1") - F.col("nv_f1")
    return out.withColumn(project, F.coalesce(project, F.lit("(all)"))).select(
        "*", delta.alias("delta_f1"),
        F.when(delta > 0, F.lit("improved")).when(delta < 0, F.lit("worse")).otherwise(F.lit("same")).alias("verdict"))


_NAMES = ("tp", "fp", "fn", "tn")


def _raw(t: Column, p: Column) -> list[Column]:
    return [F.count_if(t & p), F.count_if(~t & p), F.count_if(t & ~p), F.count_if(~t & ~p)]


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """precision, recall, f1 and support per class and weighted over all, from one pass of
    (truth, pred) counts."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.col("t").alias("class"), F.lit(1).alias("is_t"), (F.col("t") == F.col("p")).alias("hit"), "n").unionByName(
        cells.select(F.col("p").alias("class"), F.lit(0).alias("is_t"), F.lit(False).alias("hit"), "n"))
    per = sides.groupBy("class").agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("is_t") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("is_t") == 0, F.col("n")).otherwise(0)).alias("predicted"))
    p, r = ratio("tp", "predicted"), ratio("tp", "support")
    per = per.select(F.col("class").cast("string").alias("class"), p.alias("precision"), r.alias("recall"),
                     F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1"), "support")
    w = per.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")],
                F.sum("support").alias("support"))
    return per.unionByName(w.withColumn("class", F.lit("weighted")))


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes: Sequence) -> DataFrame:
    """Class by class counts; the class list is given, so that no extra pass finds it."""
    return df.groupBy(truth).pivot(pred, list(classes)).count().na.fill(0)


def roc_auc(df: DataFrame, truth: Column, score: str, bucket: Column) -> DataFrame:
    """Area under ROC as a rank sum over distinct scores; equal scores count half.

    ``bucket`` is an expression over the column ``score`` that must not decrease with it.
    """
    per = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg")).withColumn("_all", F.lit(1))
    cum = running_sum(per, ["_all"], ["score"], bucket, "neg", "neg_upto")
    area = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return cum.agg((area / (F.sum("pos") * F.sum("neg"))).alias("auc"),
                   F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def cohen_kappa(df: DataFrame, r1: Column, r2: Column, group: Sequence[str], cls: str) -> DataFrame:
    """Kappa per class, weighted by group size, and over all classes.

    Per group: equal uniform ratings give 1, unequal uniform ratings give none but their items
    still weigh in the overall value.  ``r1`` and ``r2`` are "rated yes".
    """
    g = df.groupBy(*group, cls).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(r1).alias("a"), F.count_if(r2).alias("b"),
        F.count_if(r1 == r2).alias("same"))
    n = F.col("n").cast("double")
    pe = (F.col("a") * F.col("b") + (n - F.col("a")) * (n - F.col("b"))) / (n * n)
    po = F.col("same") / n
    uniform = ((F.col("a") == 0) | (F.col("a") == n)) & ((F.col("b") == 0) | (F.col("b") == n))
    kappa = F.when(uniform, F.when(F.col("a") == F.col("b"), F.lit(1.0))).otherwise((po - pe) / (1 - pe))
    per = g.withColumn("kappa", kappa).groupBy(cls).agg(
        (F.sum(F.col("kappa") * F.col("n")) / F.sum(F.when(F.col("kappa").isNotNull(), F.col("n")))).alias("kappa"),
        F.sum("n").alias("items"))
    rated = F.when(F.col("kappa").isNotNull(), F.col("items"))
    overall = per.agg((F.sum(F.col("kappa") * F.col("items")) / F.sum(rated)).alias("kappa"), F.sum(rated).alias("items"))
    return per.select(F.col(cls).cast("string").alias("class"), "kappa", "items").unionByName(
        overall.select(F.lit("overall").alias("class"), "kappa", "items"))


def set_metrics(pred: DataFrame, truth: DataFrame, file_col: str, cls: str, name: str) -> DataFrame:
    """tp, fp, fn and ratios per class by name.

    Repeated predictions count each time; labels of files without predictions are all missed,
    and predictions in files without labels do not count.
    """
    files = truth.select(file_col).distinct()
    p = pred.join(files, file_col, "left_semi").groupBy(file_col, cls, name).agg(F.count(F.lit(1)).alias("np"))
    t = truth.groupBy(file_col, cls, name).agg(F.count(F.lit(1)).alias("nt"))
    j = p.join(t, [file_col, cls, name], "full_outer")
    counts = j.groupBy(cls).agg(
        F.sum(F.when(F.col("nt").isNotNull(), F.coalesce("np", F.lit(0))).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("nt").isNull(), F.col("np")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("np").isNull(), F.col("nt")).otherwise(0)).alias("fn"))
    return prf(counts.withColumn("tn", F.lit(0))).drop("tn", "accuracy")


WORDS = r"[^\s]+"
GRAM_SIZES = (1, 2, 4, 8, 16, 32, 64)


def _grams(word: Column) -> Column:
    """All pieces of a word whose length is one of GRAM_SIZES."""
    def of(size):
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - size + 1)),
                          lambda i: F.substring(word, i, F.lit(size)))
        return F.when(F.length(word) >= size, cut).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in GRAM_SIZES]))


def substring_matches(pred: DataFrame, truth: DataFrame, keys: Sequence[str], pred_id: str, pred_text: str,
                      truth_id: str, truth_text: str) -> DataFrame:
    """(keys, pred_id, truth_id) where the label text lies inside the predicted text, any case.

    Exact without comparing all pairs.  A word inside the label, with white space on both
    sides, must be a whole word of the prediction; the one found in the fewest predictions is
    the equality key.  A label without such a word is found through its longest piece, which
    must lie inside some word: words of the vocabulary are looked up by pieces of fixed sizes.
    Candidates are then tested on the whole texts, each of which moves once.  Blank labels are
    no labels.
    """
    t = truth.select(*keys, truth_id, F.lower(truth_text).alias("_t")).filter("trim(_t) <> ''")
    p = pred.select(*keys, pred_id, F.lower(pred_text).alias("_p"))
    words = p.select(*keys, pred_id, F.explode(F.array_distinct(
        F.regexp_extract_all("_p", F.lit(WORDS), F.lit(0)))).alias("_word"))
    vocabulary = words.groupBy("_word").agg(F.count(F.lit(1)).alias("_df"))
    inner = F.regexp_extract_all("_t", F.lit(r"(?<=\s)[^\s]+(?=\s)"), F.lit(0))
    t = t.withColumn("_inner", F.array_distinct(inner))
    spread = t.filter("size(_inner) > 0").select(*keys, truth_id, "_t", F.explode("_inner").alias("_word"))
    # the left join keeps words no prediction has: such a label is nowhere, and its key finds nothing
    whole = spread.join(vocabulary, "_word", "left").groupBy(*keys, truth_id, "_t").agg(
        F.min_by("_word", F.struct(F.coalesce("_df", F.lit(0)).alias("n"), "_word")).alias("_word"))
    pieces = F.transform(F.regexp_extract_all("_t", F.lit(WORDS), F.lit(0)),
                         lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    short = t.filter("size(_inner) = 0").withColumn("_piece", F.array_max(pieces)["w"])
    size = F.lit(GRAM_SIZES[0])
    for n in GRAM_SIZES[1:]:
        size = F.when(F.length("_piece") >= n, F.lit(n)).otherwise(size)
    short = short.select(*keys, truth_id, "_t", "_piece", F.substring(
        F.col("_piece"), F.lit(1), size).alias("_gram"))
    lookup = vocabulary.select("_word", F.explode(_grams(F.col("_word"))).alias("_gram"))
    inside = short.join(lookup, "_gram").filter("instr(_word, _piece) > 0").select(*keys, truth_id, "_t", "_word")
    labels = whole.unionByName(inside).join(words, [*keys, "_word"])
    per = labels.groupBy(*keys, pred_id).agg(
        F.collect_set(F.struct(F.col(truth_id).alias("id"), F.col("_t").alias("t"))).alias("_c"))
    held = per.join(p, [*keys, pred_id]).select(*keys, pred_id, F.explode(F.filter(
        "_c", lambda c: F.contains(F.col("_p"), c["t"]))).alias("_h"))
    return held.select(*keys, pred_id, F.col("_h.id").alias(truth_id))


def substring_metrics(pred: DataFrame, truth: DataFrame, keys: Sequence[str], pred_id: str, pred_text: str,
                      truth_id: str, truth_text: str) -> DataFrame:
    """Predictions that hold some label (tp) or none (fp), and labels held by no prediction (fn)."""
    hits = substring_matches(pred, truth, keys, pred_id, pred_text, truth_id, truth_text)
    real = truth.filter(F.trim(truth_text) != "")

    def seen(df, ident):
        h = hits.select(*keys, ident).distinct().withColumn("_h", F.lit(1))
        return df.select(*keys, ident).join(h, [*keys, ident], "left").select(F.col("_h").isNotNull().alias("hit"))
    rows = seen(pred, pred_id).withColumn("side", F.lit("p")).unionByName(
        seen(real, truth_id).withColumn("side", F.lit("t")))
    is_pred = F.col("side") == "p"
    counts = rows.agg(F.count_if(is_pred & F.col("hit")).alias("tp"), F.count_if(is_pred & ~F.col("hit")).alias("fp"),
                      F.count_if(~is_pred & ~F.col("hit")).alias("fn"), F.lit(0).alias("tn"))
    return prf(counts).drop("tn", "accuracy")


def suite_metrics(findings: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """Per weakness counts and percentages over GOOD and BAD programs, and their totals.

    Only findings whose weakness is that of the file count; unreported BAD files are missed;
    rules without findings stay as zero rows.  ``files(cwe, file_name)``,
    ``findings(cwe, file_cwe, file_name)``, ``rules(cwe)``.
    """
    own = findings.filter("cwe = file_cwe").select("cwe", "file_name").distinct().withColumn("_hit", F.lit(1))
    known = files.filter("file_name LIKE 'BAD%' OR file_name LIKE 'GOOD%'").select("cwe", "file_name").distinct()
    bad = F.col("file_name").startswith("BAD")
    hit = F.col("_hit").isNotNull()
    j = known.join(own, ["cwe", "file_name"], "full_outer").filter("file_name LIKE 'BAD%' OR file_name LIKE 'GOOD%'")
    per = j.groupBy("cwe").agg(*confusion_columns(bad, hit))
    listed = rules.select("cwe").distinct().join(per, "cwe", "full_outer").na.fill(0)
    total = listed.agg(*[F.sum(n).alias(n) for n in _NAMES]).withColumn("cwe", F.lit("total"))
    return prf(listed.select("cwe", *_NAMES).unionByName(total.select("cwe", *_NAMES)), scale=100.0)


def reviewed_metrics(agreed: DataFrame, pred: DataFrame, file_col: str = "file_name", cls: str = "class",
                     key: str = "key") -> DataFrame:
    """Counts and ratios per file and class, per class, per label and over all in one pass.

    ``agreed(file, class, key, classification, label)`` counts distinct rows rated Y or N;
    ``fn_keys`` lists the missed keys of a label.
    """
    a = agreed.filter(F.col("classification").isin("Y", "N")).select(file_col, cls, key, "classification", "label").distinct()
    p = pred.select(file_col, cls, key).distinct().withColumn("_h", F.lit(1))
    j = a.join(p, [file_col, cls, key], "left").withColumn("_y", F.col("classification") == "Y").withColumn(
        "_hit", F.col("_h").isNotNull())
    j = j.select(file_col, cls, F.coalesce("label", F.lit("")).alias("label"), "_y", "_hit")
    sets = j.groupingSets([[file_col, cls], [cls], ["label"], []], file_col, cls, "label")
    counts = sets.agg(*confusion_columns(F.col("_y"), F.col("_hit")))
    return prf(counts)


def missed_keys(agreed: DataFrame, pred: DataFrame, file_col: str = "file_name", cls: str = "class",
                key: str = "key") -> DataFrame:
    """Distinct missed keys per label and class, as rows."""
    y = agreed.filter("classification = 'Y'").select(file_col, cls, key, "label").distinct()
    return y.join(pred.select(file_col, cls, key).distinct(), [file_col, cls, key], "left_anti").select("label", cls, key).distinct()


def file_classification_accuracy(files: DataFrame, predicted: str = "names", cwe: str = "cwe",
                                 file_name: str = "file_name") -> DataFrame:
    """Share of files whose predicted list holds the weakness of their folder, or that are GOOD
    and predicted harmless or nothing."""
    good = F.col(file_name).contains("GOOD")
    harmless = F.array_contains(predicted, "non-vulnerable") | (F.size(predicted) == 0)
    right = F.coalesce(F.array_contains(F.col(predicted), F.col(cwe)), F.lit(False)) | (good & harmless)
    return files.agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("incorrect")).withColumn(
        "accuracy", ratio(F.col("correct") * 100, F.col("correct") + F.col("incorrect")))


def suite_counts(files: DataFrame, cwe: str = "cwe", file_name: str = "file_name") -> DataFrame:
    """GOOD, BAD and total programs per weakness and over all; helper files do not count."""
    good, bad = F.col(file_name).startswith("GOOD_"), F.col(file_name).startswith("BAD_")
    out = files.rollup(cwe).agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"),
                                F.count_if(good | bad).alias("total"))
    return out.withColumn(cwe, F.coalesce(cwe, F.lit("(all)")))


def label_stats(labels: DataFrame, category: str, answer: str, answers: Sequence[str] = ("Yes", "No")) -> DataFrame:
    """Counts per category and answer."""
    return labels.groupBy(category).pivot(answer, list(answers)).count().na.fill(0)


def sample_counters(samples: DataFrame, category: str, positive: Column) -> DataFrame:
    return samples.groupBy(category).agg(F.count_if(positive).alias("positive"), F.count_if(~positive).alias("negative"))


def agreed_classifications(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key lists and label lists side by side: a label gives Y, an empty one N; keys beyond the
    labels that are not listed before get None.  ``rows(keys, key_list, label_list)``."""
    zipped = rows.select(*keys, "key_list", F.size("label_list").alias("_n"), F.posexplode(
        F.arrays_zip(F.col("key_list").alias("key"), F.col("label_list").alias("label"))).alias("pos", "z"))
    z = zipped.select(*keys, "pos", "_n", "key_list", F.col("z.key").alias("key"), F.col("z.label").alias("label"))
    beyond = F.col("pos") >= F.col("_n")
    seen = F.array_contains(F.slice("key_list", F.lit(1), F.col("pos")), F.col("key"))
    return z.filter(F.col("key").isNotNull() & (~beyond | ~seen)).select(
        *keys, "pos", "key", "label",
        F.when(beyond, F.lit("None")).when(F.col("label").isNotNull(), F.lit("Y")).otherwise(F.lit("N")).alias("classification"))


def files_with_positives(agreed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return agreed.filter("classification = 'Y'").groupBy(*keys).agg(F.count(F.lit(1)).alias("positives"))
