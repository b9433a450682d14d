"""Sessions: stage machine, invalidation, run modes and a Parquet catalog with in-place updates by partition."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed order of the stages that a session has reached.
STATUSES = ("empty", "rendered", "analyzed", "clustered")
STAGES = ("rendering", "analysis", "clustering")
RUN_MODES = ("duplicate_changed", "in_place_changed", "fresh")
MOST_JOBS = 4
DEFAULT_MODEL = "mobilenet-v4-medium-v1"


@dataclass(frozen=True)
class Rendering:
    text: str = "A"
    size: int = 224
    weights: tuple[int, ...] = (400,)
    font_set: str = "system_fonts"


@dataclass(frozen=True)
class Analysis:
    model_id: str = DEFAULT_MODEL


@dataclass(frozen=True)
class Clustering:
    method: str = "complete"
    enable_preprocess_pca: bool = True
    pca_dimensions: int = 64
    distance_threshold: float = 0.25
    target_cluster_count: int = 0
    enable_attribute_emphasis: bool = False
    emphasis: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Algorithm:
    rendering: Rendering = Rendering()
    analysis: Analysis = Analysis()
    clustering: Clustering = Clustering()

    @classmethod
    def read(cls, value: dict) -> Algorithm:
        """A stored configuration: absent parts get their defaults, except that an absent emphasis switch is on."""
        r, a, c = value.get("rendering") or {}, value.get("analysis") or {}, dict(value.get("clustering") or {})
        c.setdefault("enable_attribute_emphasis", True)
        known = lambda kind, d: {k: tuple(v) if k == "weights" else v for k, v in d.items() if k in kind.__dataclass_fields__}
        return cls(Rendering(**known(Rendering, r)), Analysis(**known(Analysis, a)), Clustering(**known(Clustering, c)))

    def write(self) -> dict:
        return asdict(self)


def resume_status(status: str, old: Algorithm, new: Algorithm, override: str | None = None) -> str:
    """What a session falls back to when its configuration changes: the stage before the first one changed."""
    at = min(STATUSES.index(override or status), STATUSES.index(status))
    for i, part in enumerate(STAGES):
        if getattr(old, part) != getattr(new, part):
            at = min(at, i)
    return STATUSES[at]


def ordinal(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), status) - 1


def resume_column(status: Column, override: Column, rendering: Column, analysis: Column, clustering: Column) -> Column:
    """D2 for a table of sessions; the last three say whether that part changed."""
    top = F.lit(len(STATUSES)).cast("bigint")
    at = F.least(ordinal(status), F.coalesce(ordinal(override), ordinal(status)), *(F.when(c, F.lit(i).cast("bigint")).otherwise(top) for i, c in enumerate((rendering, analysis, clustering))))
    return F.element_at(F.array(*map(F.lit, STATUSES)), (at + 1).cast("int"))


def stages_to_run(status: str) -> tuple[str, ...]:
    """The stages that are still to run, whose progress starts anew."""
    return STAGES[min(STATUSES.index(status), len(STAGES)) :]


def needs_model(resume: str, c: Clustering) -> bool:
    """D4."""
    return resume in STATUSES[:2] or (resume == "analyzed" and c.enable_preprocess_pca and c.enable_attribute_emphasis and any(c.emphasis.values()))


def open_stages(status: Column) -> Column:
    """D1, D5 for a table of sessions: the stages that are still to run."""
    return F.slice(F.array(*map(F.lit, STAGES)), (F.least(ordinal(status), F.lit(len(STAGES)).cast("bigint")) + 1).cast("int"), len(STAGES))


def model_wanted(resume: Column, pca: Column, emphasis: Column, levels: Column) -> Column:
    """D4 for a table of sessions: before the analysis always, before the clustering if emphasis is on and some level is not 0."""
    return (ordinal(resume) < 2) | ((resume == "analyzed") & pca & emphasis & F.exists(levels, lambda v: v != 0))


def check_mode(mode: str, patch: dict) -> None:
    """D3: a fresh run states all three parts."""
    if mode not in RUN_MODES:
        raise ValueError(f"unknown run mode {mode}")
    if mode == "fresh" and not all(patch.get(p) for p in STAGES):
        raise ValueError("a fresh run needs rendering, analysis and clustering options")


def patched(old: Algorithm, patch: dict) -> Algorithm:
    """An absent part stays unchanged."""
    new = Algorithm.read({**old.write(), **{k: v for k, v in patch.items() if v is not None}})
    return new if patch.get("clustering") else replace(new, clustering=old.clustering)


class Pipeline:
    """Runs the stages that a session still needs, each from the stored table of the stage before."""

    def __init__(self, run: dict, clear, save):
        self.run, self.clear, self.save = run, clear, save

    def __call__(self, session: str, status: str) -> str:
        for stage in stages_to_run(status):
            self.clear(session, stage)  # what follows from an older run goes first
            self.run[stage](session)
            status = STATUSES[STAGES.index(stage) + 1]
            self.save(session, status)
        if status != STATUSES[-1]:
            raise RuntimeError(f"session {session} ended {status}")
        return status


def resolve(catalogs: list[Catalog], session: str, restore=None) -> Catalog:
    """The first of the catalogs (being processed, open, restored) that has the session; else the last one, into which
    ``restore(session)`` puts it back from its archive (false if there is none)."""
    found = next((c for c in catalogs if c.has("sessions", session)), None)
    if found is None and restore is not None and restore(session):
        found = catalogs[-1]
    if found is None:
        raise KeyError(session)
    return found


def cancel(spark: SparkSession, session: str) -> None:
    """Stops the Spark jobs that were started under the session's tag (``spark.addTag(session)``)."""
    spark.interruptTag(session)


class Catalog:
    """Tables of all sessions below one folder, partitioned by session.

    A session's rows are replaced by overwriting its partitions; other sessions are never read or written for that.
    """

    TABLES = ("sessions", "items", "computed", "vectors", "assignments", "leaves", "merges", "cluster_stats")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str) -> str:
        if name not in self.TABLES:
            raise ValueError(f"unknown table {name}")
        return f"{self.path}/{name}"

    def write(self, name: str, session: str, df: DataFrame) -> None:
        """All rows of one session, replaced at once when the job commits."""
        df = df.withColumn("session_id", F.lit(session))
        df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("session_id").parquet(self._at(name))

    def read(self, name: str, session: str | None = None) -> DataFrame:
        """A table, pruned to a session's partition."""
        df = self.spark.read.option("basePath", self._at(name)).parquet(self._at(name)).withColumn("session_id", F.col("session_id").cast("string"))
        return df if session is None else df.where(F.col("session_id") == session)

    def has(self, name: str, session: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self._at(name)}/session_id={session}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def create(self, config: dict) -> str:
        """A new session; ids order by time."""
        session = f"{uuid.uuid1().time:016x}-{uuid.uuid4().hex[:12]}"
        self._put(session, config, bump=True)
        return session

    def _put(self, session: str, config: dict, bump: bool) -> None:
        import json

        row = self.spark.range(1).select(F.lit(json.dumps(config, sort_keys=True)).alias("config"), F.lit(config.get("title")).cast("string").alias("title"), F.lit(config.get("process_status", "empty")).alias("process_status"))
        stamp = F.current_timestamp() if bump else F.lit(config.get("_modified_at")).cast("timestamp")
        self.write("sessions", session, row.withColumn("modified_at", stamp))

    def config(self, session: str) -> dict:
        """One member, without touching the others."""
        import json

        r = self.read("sessions", session).select("config", "modified_at").first()
        if r is None:
            raise KeyError(session)
        return json.loads(r.config) | {"_modified_at": str(r.modified_at)}

    def rename(self, session: str, title: str) -> None:
        """A new title; the time of the last change stays."""
        self._put(session, self.config(session) | {"title": title}, bump=False)

    def update(self, session: str, **changes) -> None:
        """Any other change is stamped."""
        self._put(session, {k: v for k, v in self.config(session).items() if k != "_modified_at"} | changes, bump=True)

    def duplicate(self, session: str) -> str:
        """All tables of a session under a new id."""
        new = self.create({k: v for k, v in self.config(session).items() if k != "_modified_at"})
        for name in self.TABLES[1:]:
            if self.has(name, session):
                self.write(name, new, self.read(name, session).drop("session_id"))
        return new

    def remove(self, name: str, session: str) -> bool:
        """Drops a session's rows of one table; whether there were any."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._at(name)}/session_id={session}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def listed(self, name: str) -> set[str]:
        """The sessions that have rows of a table, from its folders alone."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(name))
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return {str(x.getPath().getName()).removeprefix("session_id=") for x in fs.listStatus(at) if str(x.getPath().getName()).startswith("session_id=")} if fs.exists(at) else set()

    def reconcile(self) -> set[str]:
        """Removes what belongs to sessions without a configuration, as an ended process may leave it; the sessions it belonged to."""
        sound, left = self.listed("sessions"), set()
        for name in self.TABLES[1:]:
            for session in self.listed(name) - sound:
                self.remove(name, session)
                left.add(session)
        return left

    def delete(self, session: str) -> bool:
        """Whether there was such a session."""
        return any([self.remove(name, session) for name in self.TABLES])

    def payload(self, session: str) -> dict:
        """D15 and the load of a session: its configuration, items with assignments, and merges; the number of items is that loaded."""
        items = self.read("items", session)
        if self.has("assignments", session):
            items = items.join(self.read("assignments", session).drop("session_id"), "id", "left")
        config = self.config(session)
        if config.get("process_status") == STATUSES[-1] and not self.has("merges", session):
            raise FileNotFoundError(f"session {session} has no dendrogram")
        return {"config": config | {"samples_amount": items.count()}, "items": items, "merges": self.read("merges", session) if self.has("merges", session) else None}
