"""Comparison of two labelings through their contingency table (seg, gt, n): everything else is computed from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import AXES, Triple
from .aggregate import nonzero
from .blocks import dilated


def contingency(df: DataFrame, *, seg: str = "seg", gt: str = "gt", ignore_seg: list[int] = (), ignore_gt: list[int] = ()) -> DataFrame:
    """Counts of label pairs; pairs with an ignored label take no part."""
    if ignore_seg:
        df = df.filter(~F.col(seg).isin(*ignore_seg))
    if ignore_gt:
        df = df.filter(~F.col(gt).isin(*ignore_gt))
    return df.groupBy(F.col(seg).alias("seg"), F.col(gt).alias("gt")).agg(F.count(F.lit(1)).alias("n"))


def squares(table: DataFrame) -> DataFrame:
    """One row: n, and sums of squares of cells (s), rows (r) and columns (k), as doubles."""
    n = F.col("n").cast("double")
    cells = table.agg(F.sum(n).alias("n"), F.sum(n * n).alias("s"))
    total = lambda by, name: table.groupBy(by).agg(F.sum(n).alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias(name))
    return cells.crossJoin(total("seg", "r")).crossJoin(total("gt", "k"))  # one row each


def pair_counts(table: DataFrame) -> DataFrame:
    """a: pairs together in both, b: together in seg only, k: together in gt only, d: apart in both."""
    n, s, r, k = (F.col(x) for x in ("n", "s", "r", "k"))
    return squares(table).select(((s - n) / 2).alias("a"), ((r - s) / 2).alias("b"), ((k - s) / 2).alias("c"), ((s + n * n - r - k) / 2).alias("d"))


def rand_scores(table: DataFrame) -> DataFrame:
    """rand_index, adjusted_rand_index and fowlkes_mallows."""
    a, b, c, d = (F.col(x) for x in "abcd")
    ari = 2 * (a * d - b * c) / nonzero((a + b) * (b + d) + (a + c) * (c + d))
    return pair_counts(table).select(((a + d) / nonzero(a + b + c + d)).alias("rand_index"), F.when((b == 0) & (c == 0), 1.0).otherwise(ari).alias("adjusted_rand_index"), (a / nonzero(F.sqrt((a + b) * (a + c)))).alias("fowlkes_mallows"))


def xlogx(p: Column) -> Column:
    """p log2 p, 0 at 0."""
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def conditional_entropies(table: DataFrame, by: str) -> DataFrame:
    """Of each label of `by`: its share p, the entropy h of the other labeling within it, and p h in bits."""
    rows = table.groupBy(F.col(by).alias("label")).agg(F.sum("n").alias("m"))
    total = table.agg(F.sum("n").alias("t"))
    own = table.join(rows, F.col(by) == F.col("label")).groupBy("label", "m").agg((-F.sum(xlogx(F.col("n") / F.col("m")))).alias("h"))
    return own.crossJoin(total).select("label", (F.col("m") / F.col("t")).alias("p"), "h", (F.col("m") / F.col("t") * F.col("h")).alias("ph"))


def labelled(table: DataFrame, ignore: tuple[int, ...] = (0,)) -> DataFrame:
    """The contingency table without pairs that have a label of ignore on either side."""
    return table.filter(~(F.col("seg").isin(*ignore) | F.col("gt").isin(*ignore))) if ignore else table


def split_vi(table: DataFrame, ignore: tuple[int, ...] = (0,)) -> DataFrame:
    """false_merge: H(gt given seg), false_split: H(seg given gt), in bits, and their sum vi; labels of ignore are left out."""
    table = labelled(table, ignore)
    under = conditional_entropies(table, "seg").agg(F.sum("ph").alias("false_merge"))
    over = conditional_entropies(table, "gt").agg(F.sum("ph").alias("false_split"))
    return under.crossJoin(over).withColumn("vi", F.col("false_merge") + F.col("false_split"))


def sorted_vi_components(table: DataFrame, by: str, ignore: tuple[int, ...] = (0,)) -> DataFrame:
    """label, p, h and p h, for ordering by p h descending; labels of ignore are left out."""
    return conditional_entropies(labelled(table, ignore), by)


def evaluate(table: DataFrame, threshold: int = 1000) -> DataFrame:
    """One row: the Rand scores, the parts of vi, and the edit distance with overlaps above threshold."""
    edits = edit_distance(table, threshold).withColumnsRenamed({"false_merges": "edit_merges", "false_splits": "edit_splits"})
    return rand_scores(table).crossJoin(split_vi(table)).crossJoin(edits)  # one row each


def split_components(table: DataFrame, label: int, most: int, by: str = "seg") -> DataFrame:
    """Of the labels of the other side that overlap label: the `most` largest with label's share in them and theirs in label, largest first.

    Columns: label, overlap (share of label that lies in it) and of (share of it that lies in label).
    """
    other = "gt" if by == "seg" else "seg"
    sizes = table.groupBy(F.col(other).alias("label")).agg(F.sum("n").alias("size"))
    own = table.filter(F.col(by) == label)
    total = own.agg(F.sum("n").alias("t"))
    out = own.join(sizes, F.col(other) == F.col("label")).crossJoin(total)  # total is one row
    return out.select("label", (F.col("n") / F.col("t")).alias("overlap"), (F.col("n") / F.col("size")).alias("of")).orderBy(F.desc("overlap"), "label").limit(most)


def vi_pairwise(df: DataFrame, labelings: list[str]) -> DataFrame:
    """a, b and vi for each pair of the labelings (columns of df), a before b; labels 0 are left out."""
    out = None
    for i, a in enumerate(labelings):
        for b in labelings[i + 1 :]:
            row = split_vi(contingency(df, seg=a, gt=b)).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "vi")
            out = row if out is None else out.unionByName(row)
    return out


def vi_statistics(table: DataFrame, by: str) -> DataFrame:
    """Mean, median, largest and standard error of the vi parts (p h) of the labels of `by`."""
    ph = F.col("ph")
    return sorted_vi_components(table, by).agg(F.avg(ph).alias("mean"), F.median(ph).alias("median"), F.max(ph).alias("most"), sem(ph).alias("sem"))


def sem(value: Column) -> Column:
    """Standard error of the mean."""
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def adapted_rand_error(table: DataFrame) -> DataFrame:
    """1 - F score of pairs, with precision and recall; labels of gt that count as background should be left out before."""
    n, s, r, k = (F.col(x) for x in ("n", "s", "r", "k"))
    out = squares(table).select(((s - n) / nonzero(r - n)).alias("precision"), ((s - n) / nonzero(k - n)).alias("recall"))
    p, q = F.col("precision"), F.col("recall")
    return out.select((1 - 2 * p * q / nonzero(p + q)).alias("error"), "precision", "recall")


def edit_distance(table: DataFrame, threshold: int = 1000) -> DataFrame:
    """false_merges and false_splits: overlaps above threshold of each label beyond the first, labels 0 left out."""
    large = table.filter((F.col("n") > threshold) & (F.col("seg") != 0) & (F.col("gt") != 0))
    more = lambda by, name: large.groupBy(by).agg((F.count(F.lit(1)) - 1).alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias(name))
    return more("seg", "false_merges").crossJoin(more("gt", "false_splits"))


def boundary_precision_recall(df: DataFrame, predicted: Column, true: Column) -> DataFrame:
    """tp / (tp + fp) and tp / (tp + fn) of boolean columns."""
    count = lambda x: F.sum(x.cast("double"))
    tp, fp, fn = count(predicted & true), count(predicted & ~true), count(~predicted & true)
    return df.agg((tp / nonzero(tp + fp)).alias("precision"), (tp / nonzero(tp + fn)).alias("recall"))


def wiggle_room_precision_recall(df: DataFrame, predicted: Column, true: Column, block: Triple, margin: int = 2) -> DataFrame:
    """threshold, precision and recall for each value of predicted, a number, with drift of up to `margin` steps allowed.

    A voxel at or above the threshold is right if a voxel where `true` holds is near; one where `true` holds is found if
    a voxel at or above the threshold is near.  A value that no voxel has after dilation counts at its first voxel (in order z, y, x).
    The volume must be dense.  Counts by value are summed before they meet in the window: one row for each value.
    """
    own = df.select(*AXES, predicted.alias("value"), true.cast("int").alias("t"))
    wide = dilated(own, block, margin).withColumnRenamed("value", "wide")
    near = dilated(own.select(*AXES, F.col("t").alias("value")), block, margin).withColumnRenamed("value", "near")
    own = own.join(wide, list(AXES)).join(near, list(AXES))
    first = own.groupBy("value").agg(F.min(F.struct(*AXES)).alias("at"))
    lost = first.join(own.select(F.col("wide").alias("value")).distinct(), "value", "left_anti").select("at.*", F.col("value").alias("lost"))
    own = own.join(lost, list(AXES), "left").withColumn("wide", F.coalesce("lost", "wide"))
    by_value = own.groupBy(F.col("value").alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum("near").alias("right"))
    by_wide = own.groupBy(F.col("wide").alias("threshold")).agg(F.sum("t").alias("found"))
    down = W.orderBy(F.desc("threshold"))
    total = lambda c: F.sum(c).over(down)
    counts = by_value.join(by_wide, "threshold", "left").fillna(0, "found")  # putting lost values back may overwrite the last voxel of another
    out = counts.crossJoin(by_wide.agg(F.sum("found").alias("all")))  # all is one row
    return out.select("threshold", (total("right") / total("n")).alias("precision"), (total("found") / nonzero(F.col("all"))).alias("recall"))


def assignment_table(table: DataFrame) -> DataFrame:
    """seg with the gt label that it overlaps most (ties to the smaller)."""
    return table.groupBy("seg").agg(F.max(F.struct("n", (-F.col("gt")).alias("g"))).alias("m")).select("seg", (-F.col("m.g")).alias("gt"), F.col("m.n").alias("n"))


def merged(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """The contingency table after labels of seg are mapped (mapping: seg, target)."""
    m = mapping.select(F.col("seg").alias("__seg"), F.col("target").alias("__t"))
    return table.join(m, F.col("seg") == F.col("__seg"), "left").groupBy(F.coalesce("__t", "seg").alias("seg"), "gt").agg(F.sum("n").alias("n"))


def scores_by_threshold(df: DataFrame, value: str, gt: str, thresholds: list[float]) -> DataFrame:
    """Rand index and vi of value > t against gt, for each of a few thresholds."""
    out = None
    for t in thresholds:
        table = contingency(df.select((F.col(value) > t).cast("long").alias("seg"), F.col(gt).alias("gt")))
        row = rand_scores(table).crossJoin(split_vi(table)).select(F.lit(float(t)).alias("threshold"), "rand_index", "vi")
        out = row if out is None else out.unionByName(row)
    return out
