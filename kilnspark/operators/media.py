"""Media manifests: totals, intake rules, choice among encoded candidates, size estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.functions.scalars import half_up
from kilnspark.operators.ranked import running_sum

#: Quality, largest dimension and resolution of each profile.
PROFILES = {"balanced": (72, 2200, 96), "small": (58, 1600, 72), "quality": (84, 3000, 120), "custom": (72, 2200, 96)}


def request_totals(files: DataFrame, key: str, size: str, max_files: int, max_bytes: float) -> DataFrame:
    """Per request its files and bytes, and whether they are within the caps."""
    return files.groupBy(key).agg(F.count("*").alias("n_files"), F.sum(size).alias("total_bytes")).withColumn("allowed", (F.col("n_files") <= max_files) & (F.col("total_bytes") <= max_bytes))


def intake_reasons(rules: list[tuple[Column, str]]) -> Column:
    """The names of broken rules, in their order; the first is the reason to show."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), name) for broken, name in rules]))


def pdf_intake(files: DataFrame, profile: str, quality: str, target_mb: str, size: str, max_bytes: float) -> DataFrame:
    """files with valid and reasons: known profile, quality 25 to 90 if custom, target 1 to 200 MB, size within the cap."""
    p, q, t = F.col(profile), F.col(quality), F.col(target_mb)
    reasons = intake_reasons([(~p.isin(*PROFILES), "profile"), ((p == "custom") & ~q.between(25, 90), "quality"), (~t.between(1, 200), "target"), (F.col(size) > max_bytes, "size")])
    return files.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def compression_settings(df: DataFrame, profile: str, quality: str) -> DataFrame:
    """df with quality, max_dimension and dpi; custom clamps the quality to 25..90 and interpolates the others."""
    dims = df.sparkSession.createDataFrame([(k, *v) for k, v in PROFILES.items()], "_profile string, _quality int, _dim int, _dpi int")
    both = df.join(F.broadcast(dims), F.col(profile) == F.col("_profile"))  # four rows
    custom, q = F.col(profile) == "custom", F.greatest(F.lit(25), F.least(F.lit(90), F.coalesce(F.col(quality), F.col("_quality"))))
    along = (q - 25) / 65
    return both.select(
        *df.columns,
        F.when(custom, q).otherwise(F.col("_quality")).cast("int").alias("set_quality"),
        F.when(custom, half_up(1200 + along * 1800)).otherwise(F.col("_dim")).cast("int").alias("max_dimension"),
        F.when(custom, half_up(72 + along * 48)).otherwise(F.col("_dpi")).cast("int").alias("dpi"),
    )


def page_image_stats(paints: DataFrame, keys: list[str]) -> DataFrame:
    """Images, pixels and largest image of each page; sizes that aren't positive have no pixels."""
    pixels = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width").cast("long") * F.col("height")).otherwise(0)
    return paints.groupBy(*keys).agg(F.count("*").alias("n_images"), F.sum(pixels).alias("total_pixels"), F.max(pixels).alias("largest_pixels"))


def needs_raster(profile: Column, has_text: Column, server: bool = False) -> Column:
    """Whether a page of page_image_stats() is drawn anew; the server's rule has no clause on text."""
    heavy = (F.col("largest_pixels") >= 500_000) | (F.col("total_pixels") >= 1_000_000)
    return (F.col("n_images") > 0) & ((profile == "small") | heavy | (F.lit(False) if server else ~has_text))


def compression_report(files: DataFrame, tool: str, video: Column | None = None) -> DataFrame:
    """Per tool: files, bytes saved (never below 0), percent, files that did not get smaller, which are warned of, and those of them whose original is kept: all but videos."""
    saved, larger = F.greatest(F.lit(0.0), F.col("source_bytes") - F.col("output_bytes")), F.col("output_bytes") >= F.col("source_bytes")
    kept = larger & ~(F.lit(False) if video is None else video)
    out = files.groupBy(tool).agg(F.count("*").alias("n_files"), F.sum("source_bytes").alias("source_bytes"), F.sum(saved).alias("saved_bytes"), F.count_if(kept).alias("kept_original"), F.count_if(larger).alias("warned"))
    return out.withColumn("saved_percent", half_up(F.col("saved_bytes") / F.col("source_bytes") * 100).cast("int"))


_CHOICE = ["ord", "quality", "size"]


def _pick(order: Column, where: Column) -> Column:
    return F.min_by(F.struct(*_CHOICE), F.when(where, order))


def best_under_target(candidates: DataFrame, key: str, fallback: str = "smallest") -> DataFrame:
    """Per key the largest candidate(ord, quality, size, target) within the target, else the smallest or closest; first tried wins ties."""
    fits = F.col("size") <= F.col("target")
    spare = F.struct("size", "ord") if fallback == "smallest" else F.struct(F.abs(F.col("size") - F.col("target")).alias("d"), "ord")
    return candidates.groupBy(key).agg(F.coalesce(_pick(F.struct((-F.col("size")).alias("s"), "ord"), fits), _pick(spare, F.lit(True))).alias("c"), F.bool_or(fits).alias("target_met")).select(key, "c.*", "target_met")


def first_under_target(candidates: DataFrame, key: str) -> DataFrame:
    """Per key the first candidate tried that fits, else the last tried."""
    fits = F.col("size") <= F.col("target")
    return candidates.groupBy(key).agg(F.coalesce(_pick(F.col("ord"), fits), _pick(-F.col("ord"), F.lit(True))).alias("c"), F.bool_or(fits).alias("target_met")).select(key, "c.*", "target_met")


def nearest_to_target(candidates: DataFrame, key: str, far: float = 1_000_000) -> DataFrame:
    """Per key the valid candidate closest to the target, with a warning if it is far off."""
    order = F.struct(F.abs(F.col("size") - F.col("target")).alias("d"), "ord")
    out = candidates.where("valid").groupBy(key).agg(_pick(order, F.lit(True)).alias("c"), F.min(F.abs(F.col("size") - F.col("target"))).alias("distance"))
    return out.select(key, "c.*", "distance", (F.col("distance") > far).alias("warn"))


def within_window(size: Column, target: Column, browser: bool = False) -> Column:
    """Whether a size meets its target: not above, and below by no more than 10,000 bytes, or 2 % (1,024 at least)."""
    slack = F.lit(10_000) if browser else F.greatest(F.lit(1024), target * 0.02)
    return (F.abs(size - target) <= slack) if browser else ((size <= target) & (size >= target - slack))


def estimate_output(pages: DataFrame, doc: str, cap: dict[str, float], samples: int = 8) -> DataFrame:
    """Per document(doc, page_index, heavy, sampled_bytes, source_bytes, profile) the estimated size and percent saved.

    Of the heavy pages up to `samples` evenly spaced ones are averaged and
    scaled to all; the rest keeps 78 % of its share; a page costs 2,800 bytes
    more; the profile's ratio caps the whole, 1,000 bytes are the least.
    """
    w = Window.partitionBy(doc)
    heavy = pages.withColumn("h", F.sum(F.col("heavy").cast("int")).over(w.orderBy("page_index"))).withColumn("n_heavy", F.sum(F.col("heavy").cast("int")).over(w))
    k = F.least(F.lit(samples), F.col("n_heavy"))
    spots = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: half_up(i * (F.col("n_heavy") - 1) / F.greatest(F.lit(1), k - 1)))
    chosen = F.col("heavy") & F.array_contains(spots, (F.col("h") - 1).cast("long"))
    ratio = F.coalesce(*[F.when(F.col("profile") == p, F.lit(r)) for p, r in cap.items()], F.lit(1.0))
    sums = heavy.withColumn("ratio", ratio).withColumn("chosen", chosen).groupBy(doc).agg(F.count("*").alias("n_pages"), F.max("n_heavy").alias("heavies"), F.max("source_bytes").alias("source_bytes"), F.max("ratio").alias("ratio"), F.avg(F.when(F.col("chosen"), F.col("sampled_bytes"))).alias("mean"))
    redrawn = F.coalesce(F.col("mean"), F.lit(0.0)) * F.col("heavies")
    whole = redrawn + 0.78 * F.col("source_bytes") * (F.col("n_pages") - F.col("heavies")) / F.col("n_pages") + 2800 * F.col("n_pages")
    size = F.greatest(F.lit(1000.0), F.least(whole, F.col("source_bytes") * F.col("ratio")))
    return sums.select(doc, half_up(size).cast("long").alias("estimated"), F.greatest(F.lit(0), half_up((1 - size / F.col("source_bytes")) * 100)).cast("int").alias("saved_percent"))


def top_fraction_mean(samples: DataFrame, key: str, weight: str, channel: str, fraction: float = 0.2, least: float = 35) -> DataFrame:
    """Per key the rounded mean of the channel over its strongest samples: a fraction of those above `least`, one at least."""
    strong = samples.where(F.col(weight) > least)
    ranked = running_sum(strong, [key], [-F.col(weight), F.col(channel)], F.lit(1), "_before")
    sizes = strong.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    both = ranked.join(sizes.hint("merge"), F.col(key).eqNullSafe(F.col("_key")))
    means = both.where(F.col("_before") < F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction))).groupBy("_key").agg(half_up(F.avg(channel)).cast("long").alias("mean"))
    return samples.select(key).distinct().join(means.hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("mean", F.lit(0).cast("long")).alias("mean"))


def mask_difference(a: Column, b: Column, threshold: float = 0.28) -> Column:
    """Mean of 0.7 times the difference and 0.3 for each pair that falls on two sides of the threshold."""
    parts = F.zip_with(a, b, lambda x, y: 0.7 * F.abs(x - y) + F.when((x >= threshold) != (y >= threshold), 0.3).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def pick_asset(assets: DataFrame, platforms: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """Per platform the asset(name, ord) with the best-scored ending, first listed on ties."""
    rules = [(p, e, s) for p, ends in platforms.items() for e, s in ends]
    dim = assets.sparkSession.createDataFrame(rules, "platform string, ending string, score int")
    found = assets.withColumn("ending", F.regexp_extract(F.lower("name"), "([^. ]+)$", 1)).join(F.broadcast(dim), "ending")  # a list written by hand
    return found.groupBy("platform").agg(F.min_by("name", F.struct("score", "ord")).alias("name"))


def new_files(chosen: DataFrame, existing: DataFrame) -> DataFrame:
    """Files(name, size, modified) that aren't chosen already."""
    return chosen.join(existing, ["name", "size", "modified"], "left_anti")
