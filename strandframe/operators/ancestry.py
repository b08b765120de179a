"""Reference panels and ancestry: panel quality, range exclusion, LD pruning, principal components, projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.alleles import complement, is_palindromic
from ..schema import AUTOSOMES
from .keys import LOCUS

LEAST_MAF, MOST_MISSING, LD_R2, LD_WINDOW = 0.05, 0.02, 0.2, 200_000
LEAST_COVERAGE = 0.5


def panel_site_qc(dosages: DataFrame, least_maf: float = LEAST_MAF, most_missing: float = MOST_MISSING) -> DataFrame:
    """Sites kept of a long table (variant_id, chrom, pos_grch37, ref, alt, sample_id, dosage null for missing)."""
    site = ["variant_id", *LOCUS, "ref", "alt"]
    stats = dosages.groupBy(*site).agg(F.count("*").alias("n_samples"), F.count("dosage").alias("n_called"), F.sum("dosage").alias("alt_copies"))
    frequency = F.when(F.col("n_called") > 0, F.col("alt_copies") / (2 * F.col("n_called")))
    rated = stats.withColumn("maf", F.round(F.least(frequency, 1 - frequency), 6)).withColumn("missing", F.round(1 - F.col("n_called") / F.col("n_samples"), 6))
    bases = F.col("ref").isin("A", "C", "G", "T") & F.col("alt").isin("A", "C", "G", "T")
    return rated.where(bases & (F.col("maf") >= least_maf) & (F.col("missing") <= most_missing)).select(*site, "maf", "missing")


def drop_duplicate_sites(sites: DataFrame, keys: list[str]) -> DataFrame:
    """Sites whose key occurs once; all copies of a repeated one go."""
    once = sites.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return sites.join(once, keys, "left_semi")


def exclude_ranges(sites: DataFrame, ranges: DataFrame, bin_width: int = 1_000_000) -> DataFrame:
    """Sites outside all closed intervals (chrom, from_pos, to_pos), by an equi-join on position bins."""
    bins = F.sequence(F.floor(F.col("from_pos") / bin_width), F.floor(F.col("to_pos") / bin_width))
    cut = ranges.select("chrom", "from_pos", "to_pos", F.explode(bins).alias("__bin"))
    placed = sites.withColumn("__bin", F.floor(F.col("pos_grch37") / bin_width))
    on = (placed["chrom"] == cut["chrom"]) & (placed["__bin"] == cut["__bin"]) & placed["pos_grch37"].between(cut["from_pos"], cut["to_pos"])
    return placed.join(cut, on, "left_anti").drop("__bin")


def panel_array_intersection(sites: DataFrame, table: DataFrame) -> DataFrame:
    """Autosomal panel sites whose locus the array has; no-calls count."""
    loci = table.where(F.col("chrom").isin(*AUTOSOMES)).select(*LOCUS).distinct()
    return sites.join(loci, LOCUS, "left_semi")


def harmonize(sites: DataFrame, probes: DataFrame) -> DataFrame:
    """One outcome per panel site, and the sample's copies of the alternative allele where it can be read."""
    j = sites.join(probes, LOCUS, "left")
    other = complement(F.col("genotype"))

    def fits(g):
        a, b = F.substring(g, 1, 1), F.substring(g, 2, 1)
        return ((a == F.col("ref")) | (a == F.col("alt"))) & ((b == F.col("ref")) | (b == F.col("alt")))

    outcome = (
        F.when(F.col("n_probes").isNull(), "not_on_array")
        .when(F.col("conflict"), "duplicate_conflict")
        .when(F.col("genotype").isNull(), "no_call")
        .when(is_palindromic(F.col("ref"), F.col("alt")), "ambiguous_site")
        .when(fits(F.col("genotype")), "as_written")
        .when(F.coalesce(fits(other), F.lit(False)), "complemented")
        .otherwise("allele_mismatch")
    )
    read = F.when(F.col("outcome") == "as_written", F.col("genotype")).when(F.col("outcome") == "complemented", other)
    copies = (F.substring(read, 1, 1) == F.col("alt")).cast("int") + (F.substring(read, 2, 1) == F.col("alt")).cast("int")
    return j.withColumn("outcome", outcome).select("variant_id", *LOCUS, "outcome", copies.alias("dosage"))


def project(dosages: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, component, score, n_used): the average of weight times standardized dosage over the called sites.

    `weights` has variant_id, frequency, component and weight. Sites of no variance and missing calls are
    skipped, not imputed.
    """
    spread = F.sqrt(2 * F.col("frequency") * (1 - F.col("frequency")))
    used = dosages.where("dosage is not null").join(weights.where("frequency > 0 and frequency < 1"), "variant_id")
    scored = used.groupBy("sample_id", "component").agg(F.sum(F.col("weight") * (F.col("dosage") - 2 * F.col("frequency")) / spread).alias("total"), F.count("*").alias("n_used"))
    return scored.select("sample_id", "component", F.round(F.col("total") / F.col("n_used"), 6).alias("score"), "n_used")


def covered_projection(dosages: DataFrame, weights: DataFrame, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """project(), refused if some sample has called less than a share of the weighted markers."""
    coverage = projection_coverage(dosages, weights).first()["coverage"] or 0.0
    if coverage < least_coverage:
        raise ValueError(f"a sample has called {coverage} of the markers, less than {least_coverage}")
    return project(dosages, weights)


def projection_coverage(dosages: DataFrame, weights: DataFrame) -> DataFrame:
    """The least share of weighted markers that a sample has called."""
    markers = weights.select("variant_id").distinct()
    per_sample = dosages.where("dosage is not null").join(markers, "variant_id", "left_semi").groupBy("sample_id").agg(F.count_distinct("variant_id").alias("n"))
    return per_sample.agg(F.min("n").alias("least_called")).crossJoin(markers.agg(F.count("*").alias("n_markers"))).select("least_called", "n_markers", F.when(F.col("n_markers") > 0, F.round(F.col("least_called") / F.col("n_markers"), 6)).otherwise(0.0).alias("coverage"))


def _samples(dosages: DataFrame) -> list:
    """The samples in order: all that the driver and each task hold of them is a list of ids."""
    return [r[0] for r in dosages.select("sample_id").distinct().orderBy("sample_id").collect()]


def _site_calls(dosages: DataFrame) -> DataFrame:
    """(variant_id, chrom, pos_grch37, calls): a row per site, its dosages in order of the samples as bytes, -1 for missing."""
    place = {x: i for i, x in enumerate(_samples(dosages))}
    kind = dosages.schema["variant_id"].dataType.simpleString()
    sites = dosages.groupBy("variant_id", *LOCUS).agg(F.collect_list("sample_id").alias("s"), F.collect_list(F.coalesce("dosage", F.lit(-1)).cast("tinyint")).alias("d"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.full((len(batch), len(place)), -1, dtype=np.int8)
            for i, (ids, values) in enumerate(zip(batch["s"], batch["d"], strict=True)):
                rows[i, [place[x] for x in ids]] = values
            yield batch[["variant_id", "chrom", "pos_grch37"]].assign(calls=[r.tobytes() for r in rows])

    return sites.mapInPandas(packed, f"variant_id {kind}, chrom string, pos_grch37 long, calls binary")


#: Cells of the matrices of a task, whatever its number of sites.
MOST_CELLS = 1 << 18


def _correlations() -> tuple[Callable, Callable, Callable]:
    """(unpacked, rated, passes), made here so that they go to the workers with the tasks, which need not find this package."""

    def unpacked(calls: pd.Series) -> np.ndarray:
        return np.stack([np.frombuffer(b, dtype=np.int8) for b in calls])

    def rated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The squared correlation of each row of `x` with each of `y` over the calls of both; -1 where one does not vary."""
        a, b = (x >= 0).astype(np.float64), (y >= 0).astype(np.float64)
        x, y = x * a, y * b
        n, sx, sy = a @ b.T, x @ b.T, a @ y.T
        cov, vx, vy = n * (x @ y.T) - sx * sy, n * ((x * x) @ b.T) - sx * sx, n * (a @ (y * y).T) - sy * sy
        varies = (vx > 0) & (vy > 0)
        return np.where(varies, cov * cov / np.where(varies, vx * vy, 1), -1.0)

    def passes(values: np.ndarray, r2: float) -> np.ndarray:
        """Whether values, rounded to six places as F.round does, are above `r2`."""
        out = values > r2 + 1e-6
        for i in np.flatnonzero(~out & (values > r2 - 1e-6)):
            out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) > r2
        return out

    return unpacked, rated, passes


def linked_pairs(dosages: DataFrame, window: int = LD_WINDOW, r2: float = LD_R2) -> DataFrame:
    """(chrom, keep_id, drop_id, r2): pairs of sites within a window whose squared correlation passes `r2`; missing calls count for neither of a pair.

    Each site's calls go to two tasks, as bytes: to that of its position bin, as wide as the window, and to that of
    the bin before. A task multiplies its sites with their neighbours as matrices of MOST_CELLS cells and hands on what it
    finds in each, so that it holds its sites but never their pairs.
    """
    unpacked, rated, _ = _correlations()
    own = F.floor(F.col("pos_grch37") / window)
    dealt = _site_calls(dosages).withColumn("own", own).withColumn("bin", F.explode(F.array(F.col("own"), F.col("own") - 1)))

    def correlated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(batches)).sort_values(["pos_grch37", "variant_id"], ignore_index=True)
        calls, pos, ids, chrom = unpacked(group["calls"]), group["pos_grch37"].to_numpy(), group["variant_id"], group["chrom"].iloc[0]
        left = np.flatnonzero((group["own"] == group["bin"]).to_numpy())
        side = max(1, min(256, MOST_CELLS // max(1, calls.shape[1])))
        across = max(1, min(MOST_CELLS // side, MOST_CELLS // max(1, calls.shape[1])))
        for start in range(0, len(left), side):
            i = left[start : start + side]
            end = np.searchsorted(pos, pos[i[-1]] + window, side="right")
            for begin in range(i[0] + 1, end, across):
                j = np.arange(begin, min(begin + across, end))
                values = rated(calls[i], calls[j])
                # rounded later, so a little below the limit may pass
                a, b = np.nonzero((j > i[:, None]) & (pos[j] - pos[i][:, None] <= window) & (values >= 0) & (values > r2 - 1e-6))
                if len(a):
                    yield pd.DataFrame({"chrom": chrom, "keep_id": ids.iloc[i[a]].to_numpy(), "drop_id": ids.iloc[j[b]].to_numpy(), "r2": values[a, b]})

    kind = dosages.schema["variant_id"].dataType.simpleString()
    # applyInPandas reads from these whether the function takes iterators
    correlated.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    pairs = dealt.groupBy("chrom", "bin").applyInPandas(correlated, f"chrom string, keep_id {kind}, drop_id {kind}, r2 double")
    return pairs.withColumn("r2", F.round("r2", 6)).where(F.col("r2") > r2)


#: Blocks of the greedy walk, in windows.
WALK_WINDOWS = 16


def ld_prune(dosages: DataFrame, window: int = LD_WINDOW, r2: float = LD_R2) -> DataFrame:
    """(variant_id): what a greedy walk along each chromosome keeps: a site stays if no kept earlier one is linked to it.

    Blocks of positions are walked at the same time, each with the sites of the window before it and given which of
    those went. At first none did; blocks whose sites before turn out otherwise are walked again, until nothing changes.
    As block after block is final, that ends, mostly after a few rounds: what happened at one end of a block seldom
    reaches the other. A site is compared with the kept ones before it, a chunk at a time: no pairs are stored.
    """
    unpacked, rated, passes = _correlations()
    width = window * WALK_WINDOWS
    own = F.floor(F.col("pos_grch37") / width)
    near_next = F.col("pos_grch37") >= (F.col("own") + 1) * width - window
    calls = _site_calls(dosages).withColumn("own", own)
    dealt = checkpointed(calls.withColumn("block", F.explode(F.when(near_next, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own")))))
    kind = dosages.schema["variant_id"].dataType.simpleString()

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pos_grch37", "variant_id"], ignore_index=True)
        calls, pos, ids = unpacked(group["calls"]), group["pos_grch37"].to_numpy(), group["variant_id"].tolist()
        ours = (group["own"] == group["block"]).to_numpy()
        gone, kept = set(group.loc[group["gone"], "variant_id"]), []
        chunk = max(1, MOST_CELLS // max(1, calls.shape[1]))
        for i, site in enumerate(ids):
            if site in gone:
                continue
            if ours[i]:
                kept = [k for k in kept if pos[i] - pos[k] <= window and ids[k] not in gone]
                # latest first, as near sites are linked more often
                for end in range(len(kept), 0, -chunk):
                    if passes(rated(calls[i : i + 1], calls[kept[max(0, end - chunk) : end]])[0], r2).any():
                        gone.add(site)
                        break
            if site not in gone:
                kept.append(i)
        dropped = sorted({x for x, o in zip(ids, ours, strict=True) if o and x in gone})
        return pd.DataFrame({"chrom": group["chrom"].iloc[0], "block": group["block"].iloc[0], "variant_id": dropped})

    form = f"chrom string, block long, variant_id {kind}"
    crossing = dealt.where("own < block").select("chrom", F.col("own").alias("from"), "variant_id", F.col("block").alias("into")).distinct()
    before, dropped, stale = None, None, None
    while True:
        todo = dealt if stale is None else dealt.join(stale, ["chrom", "block"], "left_semi")
        if before is None:
            marked = todo.withColumn("gone", F.lit(False))
        else:
            flags = before.select(F.col("chrom").alias("c"), F.col("variant_id").alias("v"), F.col("into").alias("b"), F.lit(True).alias("gone"))
            marked = todo.join(flags, (todo.chrom == flags.c) & (todo.variant_id == flags.v) & (todo.block == flags.b) & (todo.own < todo.block), "left").drop("c", "v", "b").withColumn("gone", F.coalesce("gone", F.lit(False)))
        walked = marked.groupBy("chrom", "block").applyInPandas(walk, form)
        dropped = checkpointed(walked if dropped is None else dropped.join(stale, ["chrom", "block"], "left_anti").unionByName(walked))
        left = dropped.withColumnRenamed("block", "from")
        now = checkpointed(crossing.join(left, ["chrom", "from", "variant_id"], "left_semi").select("chrom", "variant_id", "into"))
        moved = now if before is None else now.exceptAll(before).unionByName(before.exceptAll(now))
        stale = checkpointed(moved.select("chrom", F.col("into").alias("block")).distinct())
        before = now
        if stale.isEmpty():
            return dosages.select("variant_id").distinct().join(dropped.select("variant_id").distinct(), "variant_id", "left_anti")


#: The driver holds so many more directions than asked for, and at most so many blocks of them at once.
SPARE, MOST_BLOCKS = 8, 12


def reference_components(dosages: DataFrame, k: int = 10, least_samples: int = 50, least_markers: int = 1000, tolerance: float = 1e-9) -> DataFrame:
    """(variant_id, frequency, component, weight): leading axes of standardized dosages, missing calls at the mean.

    Fewer samples than `least_samples` or varying markers than `least_markers` are refused. Weights have length one, the
    largest of a component is positive; components without variance are left out.

    The products of the sites with some directions of the samples are summed over all tasks, and the directions turned
    until they stay: a block Krylov iteration, kept orthogonal, and begun anew from the best ones when it holds
    MOST_BLOCKS blocks. The driver has samples x directions only, and no task a matrix of samples squared.
    """
    called = dosages.where("dosage is not null")
    stats = called.groupBy("variant_id").agg((F.avg("dosage") / 2).alias("frequency")).where("frequency > 0 and frequency < 1")
    samples = _samples(dosages)
    n = len(samples)
    if n < least_samples:
        raise ValueError(f"{n} samples, fewer than {least_samples}")
    if least_markers and (markers := stats.count()) < least_markers:
        raise ValueError(f"{markers} varying markers, fewer than {least_markers}")
    form = dosages.schema["sample_id"].dataType.simpleString()
    numbers = dosages.sparkSession.createDataFrame(list(enumerate(samples)), f"i int, sample_id {form}")
    z = called.join(stats, "variant_id").join(numbers, "sample_id").select("variant_id", "frequency", "i", ((F.col("dosage") - 2 * F.col("frequency")) / F.sqrt(2 * F.col("frequency") * (1 - F.col("frequency")))).alias("z"))
    sites = checkpointed(z.groupBy("variant_id", "frequency").agg(F.collect_list("i").alias("i"), F.collect_list("z").alias("z")))
    if not n or sites.isEmpty():
        return stats.limit(0).select("variant_id", "frequency", F.lit(0).alias("component"), F.lit(0.0).alias("weight"))
    values, axes = _leading(lambda v: _site_products(sites, v), n, k, tolerance)
    scaled = axes / np.sqrt(values)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = _rows(batch, n) @ scaled
            yield pd.DataFrame({"variant_id": np.repeat(batch["variant_id"].to_numpy(), scaled.shape[1]), "frequency": np.repeat(batch["frequency"].to_numpy(), scaled.shape[1]), "component": np.tile(np.arange(1, scaled.shape[1] + 1, dtype=np.int32), len(batch)), "weight": rows.ravel()})

    kind = dosages.schema["variant_id"].dataType.simpleString()
    weights = sites.mapInPandas(weighed, f"variant_id {kind}, frequency double, component int, weight double")
    signs = weights.groupBy("component").agg(F.signum(F.max_by("weight", F.struct(F.round(F.abs("weight"), 12), "variant_id"))).alias("sign"))
    # a row a component
    return weights.join(F.broadcast(signs), "component").select("variant_id", "frequency", "component", (F.col("weight") * F.col("sign")).alias("weight"))


def _rows(batch: pd.DataFrame, n: int) -> np.ndarray:
    rows = np.zeros((len(batch), n))
    for at, (i, z) in enumerate(zip(batch["i"], batch["z"], strict=True)):
        rows[at, i] = z
    return rows


def _site_products(sites: DataFrame, directions: np.ndarray) -> np.ndarray:
    """The sum over sites of z (z v) for the columns v of `directions`; each task sends one matrix of that shape, in pieces."""
    n, width = directions.shape
    piece = max(1, (1 << 16) // max(1, width))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, width))
        for batch in batches:
            rows = _rows(batch, n)
            total += rows.T @ (rows @ directions)
        yield pd.DataFrame({"at": range(0, n, piece), "part": [total[i : i + piece].tobytes() for i in range(0, n, piece)]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": frame["at"].iloc[:1], "part": [np.sum([np.frombuffer(b) for b in frame["part"]], axis=0).tobytes()]})

    parts = sites.mapInPandas(products, "at int, part binary").groupBy("at").applyInPandas(added, "at int, part binary").toPandas().sort_values("at")
    return np.concatenate([np.frombuffer(b) for b in parts["part"]]).reshape(n, width)


def _leading(product: Callable[[np.ndarray], np.ndarray], n: int, k: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, but for zeros, and eigenvectors of a symmetric n x n matrix that is known by its products."""
    wide = min(n, k + SPARE)
    block = np.linalg.qr(np.random.default_rng(1).normal(size=(n, wide)))[0]
    basis, image = np.zeros((n, 0)), np.zeros((n, 0))
    while True:
        basis, image = np.hstack([basis, block]), np.hstack([image, product(block)])
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        axes, moved = basis @ turns, image @ turns
        rest = np.linalg.norm(moved[:, :k] - axes[:, :k] * values[:k], axis=0)
        if basis.shape[1] == n or not block.shape[1] or rest.max() <= tolerance * max(values[0], 1e-300):
            some = values[:k] > 1e-10 * max(values[0], 0)
            return values[:k][some], axes[:, :k][:, some]
        fresh = image[:, -block.shape[1] :]
        if basis.shape[1] + wide > MOST_BLOCKS * wide:
            fresh = moved[:, :wide] - axes[:, :wide] * values[:wide]
            basis, image = axes[:, :wide], moved[:, :wide]
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        left, size, _ = np.linalg.svd(fresh, full_matrices=False)
        block = left[:, size > 1e-12 * max(size[0], 1e-300)][:, : n - basis.shape[1]]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
