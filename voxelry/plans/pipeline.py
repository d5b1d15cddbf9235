"""The tracking pipeline: detect, segment, link, erode, share, merge into systems; resumable by stage."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import total
from ..model import DIMS, Grid
from ..operators import detect, erosion, labelling, sharing
from ..sources.readers import Checkpoints
from ..storage import Scratch


@dataclass
class ObjectClass:
    """How one class of objects is found: the sum of its fields, smoothed by sigma, nested thresholds, seeds (the features' voxels, or boxes) and tracking."""

    name: str
    fields: list[str]
    thresholds: list[float]
    min_size: int = 1
    min_distance: float = 0.0
    segment_above: float | None = None
    radius: float = 1.0
    min_steps: int = 1
    erode: float | None = 0.5
    sigma: float = 0.0
    erode_mask: int = 0
    seed_box: int | None = None
    predict: int = 0


@dataclass
class Config:
    """Grid, the two classes in order (the first names systems, the second lies within), and the overlap rule."""

    objects: list[ObjectClass]
    grid: Grid = field(default_factory=Grid)
    periodic: tuple[str, ...] = ()
    overlap_per_time: bool = False


def amend(base: dict, changes: dict) -> dict:
    """base with changes laid over it, nested dictionaries key by key."""
    out = dict(base)
    for key, value in changes.items():
        out[key] = amend(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def configure(tree: dict) -> Config:
    known = {f.name for f in fields(ObjectClass)}
    objects = []
    for name, options in tree["objects"].items():
        if wrong := set(options) - known:
            raise ValueError(f"unknown options of {name}: {sorted(wrong)}")
        objects.append(ObjectClass(name, **options))
    return Config(objects, Grid(**tree.get("grid", {})), tuple(tree.get("periodic", ())), bool(tree.get("overlap_per_time", False)))


def load(path: str, changes: dict | None = None) -> Config:
    """A configuration from a YAML file, with changes laid over it."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return configure(amend(yaml.safe_load(f), changes or {}))


def track_object(spark: SparkSession, table: DataFrame, how: ObjectClass, config: Config, stages: Checkpoints) -> DataFrame:
    """t, z, y, x, label of one class: features are segmented and linked, and with `erode` what touches through thin necks is parted."""
    grid = config.grid
    value = table.withColumn("_value", total([F.col(c) for c in how.fields])).where("_value IS NOT NULL")

    def found(kind: int):
        return lambda: detect.detect_features(value, "_value", how.thresholds, how.min_size, grid, Scratch(spark), how.min_distance, how.sigma, how.erode_mask, config.periodic)[kind]

    features = stages.get(f"{how.name}_features", found(0))
    members = stages.get(f"{how.name}_members", found(1))
    above = min(how.thresholds) if how.segment_above is None else how.segment_above
    seeds = members if how.seed_box is None else detect.box_seeds(features, how.seed_box, grid)
    segments = stages.get(f"{how.name}_segments", lambda: detect.watershed(value, "_value", seeds, above, grid, Scratch(spark), periodic=config.periodic))
    cells = stages.get(f"{how.name}_cells", lambda: detect.link_features(features, how.radius, Scratch(spark), min_steps=how.min_steps, predict=how.predict))

    def tracks() -> DataFrame:
        mapping = cells.select(F.col("feature").alias("old"), F.col("cell").alias("new"))
        mask = labelling.apply_mapping(segments, mapping, "feature", to="label").select(*DIMS, "label")
        if how.erode is None:
            return mask
        cores = erosion.weighted_erode(mask, _extent(table, "y"), _extent(table, "x"), how.erode)
        apart = labelling.label(cores.select(*DIMS), grid, Scratch(spark), periodic=config.periodic)
        shared = sharing.share_labels(mask, apart.select(*DIMS, "label"))
        return labelling.force_consecutive(shared, Scratch(spark)).select(*DIMS, "label")

    return stages.get(f"{how.name}_tracks", tracks)


def _extent(table: DataFrame, dim: str) -> int:
    return int(table.agg(F.max(dim)).first()[0] or 0) + 1


def run(spark: SparkSession, table: DataFrame, config: Config, root: str) -> DataFrame:
    """The systems (t, z, y, x, system, u_tracks) of a field table; finished stages under root are used again."""
    stages = Checkpoints(spark, root)
    outer, inner = (track_object(spark, table, how, config, stages) for how in config.objects)
    inner = stages.get("inner_overlapping", lambda: labelling.overlapping(outer, inner, config.overlap_per_time).select(*DIMS, "label"))
    return stages.get("systems", lambda: sharing.multivariate_systems(outer, inner, Scratch(spark)))


__all__ = ["Config", "ObjectClass", "amend", "configure", "load", "run"]
