"""A directory of tables with its catalogue: windows, datasets, classifiers, and what the model and clips of the store are."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldchirp.operators import selection, store


class Registry:
    """Named datasets and classifiers beside an embedding store, kept as Parquet folders and one JSON file.

    The catalogue is what the driver keeps: names, paths and weights.  Every
    change is written at once and whole, to a new file renamed over the old.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("x").getFileSystem(conf)
        self.entries: dict = {"metadata": {}, "datasets": {}, "classifiers": {}, "version": 0}
        if self._fs.exists(self._path("catalogue.json")):
            lines = spark.read.text(f"{self.folder}/catalogue.json", wholetext=True).first()
            self.entries = json.loads(lines[0])

    def save(self) -> None:
        out = self._fs.create(self._path("catalogue.json.new"), True)
        out.write(bytearray(json.dumps(self.entries, sort_keys=True).encode()))
        out.close()
        self._fs.delete(self._path("catalogue.json"), False)
        self._fs.rename(self._path("catalogue.json.new"), self._path("catalogue.json"))

    def _once(self, key: str, value) -> None:
        """Set a fact of the store at the first time; ``ValueError`` if it is another later."""
        have = self.entries["metadata"].setdefault(key, value)
        if have != value:
            raise ValueError(f"the store's {key} is {have}, not {value}")
        self.save()

    def check_model(self, model_id: str) -> None:
        self._once("model_id", model_id)

    def check_clip_duration(self, seconds: float) -> None:
        self._once("clip_duration", seconds)

    # ---- windows

    def windows(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/windows") if self._fs.exists(self._path("windows")) else None

    def insert(self, windows: DataFrame, mode: str = "skip", limit: float | None = None) -> DataFrame:
        """Append windows (window_id, file, start_time, end_time, embedding, ...); returns those refused, with the reason.

        Windows whose embedding is missing aren't stored.  skip leaves out
        those the store has and repeats within the batch, error raises on the
        former, add stores all.
        """
        failed = windows.where("embedding is null").select(*store.WINDOW_KEY, F.lit("no embedding").alias("reason"))
        good = windows.where("embedding is not null")
        good = good.withColumn("embedding", store.clip_values(F.col("embedding"), limit)) if limit is not None else good
        old = self.windows()
        new = good if mode == "add" else store.first_windows(good)
        if old is not None:
            new = store.missing_windows(new, old, mode)
        repeated = store.normal_windows(good).join(new.select("window_id"), "window_id", "left_anti").select(*store.WINDOW_KEY, F.lit("duplicate window").alias("reason"))
        version = self.entries["version"] + 1
        refused = failed.unionByName(repeated)
        path = f"{self.folder}/refused/v={version}"
        refused.write.mode("overwrite").parquet(path)
        new.write.mode("overwrite").parquet(f"{self.folder}/windows/v={version}")
        self.entries["version"] = version
        self.save()
        return self.spark.read.schema(refused.schema).parquet(path)

    def embeddings_of(self, clips: DataFrame) -> DataFrame:
        """Clips with the embedding of their first window, null where the store has none."""
        have = store.first_windows(self.windows()).select(*store.WINDOW_KEY, "window_id", "embedding")
        return store.normal_windows(clips).join(have, store.WINDOW_KEY, "left")

    # ---- datasets and classifiers

    def add_dataset(self, name: str, labels: DataFrame, allow_training: bool = True, mode: str = "error", classes: list[str] | None = None) -> None:
        """Label table (file, start_time, end_time, classes...) under a name; an existing one is merged by ``mode`` (skip, add) or refused (error)."""
        known = self.entries["datasets"].get(name)
        if known and mode == "error":
            raise ValueError(f"there is a dataset {name} already")
        version = (known or {"version": 0})["version"] + 1
        if known:
            old = self.dataset(name)
            have = classes or [c for c in {**dict.fromkeys(old.columns), **dict.fromkeys(labels.columns)} if c not in store.WINDOW_KEY]
            fill = lambda d: d.select(*store.WINDOW_KEY, *[F.col(c) if c in d.columns else F.lit(None).cast("double").alias(c) for c in have])
            labels = store.merge_labels(fill(old), fill(labels), have, mode)
        path = f"datasets/{name}/v={version}"
        labels.write.parquet(f"{self.folder}/{path}")
        self.entries["datasets"][name] = {"path": path, "version": version, "allow_training": allow_training}
        self.save()

    def dataset(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.entries['datasets'][name]['path']}")

    def remove_dataset(self, name: str) -> None:
        del self.entries["datasets"][name]
        self.save()

    def datasets(self) -> list[str]:
        return sorted(self.entries["datasets"])

    def add_classifier(self, name: str, weights: dict[str, list[float]], bias: dict[str, float] | None = None) -> None:
        if name in self.entries["classifiers"]:
            raise ValueError(f"there is a classifier {name} already")
        self.entries["classifiers"][name] = {"weights": weights, "bias": bias or {}}
        self.save()

    def remove_classifier(self, name: str) -> None:
        del self.entries["classifiers"][name]
        self.save()

    def classifiers(self) -> list[str]:
        return sorted(self.entries["classifiers"])

    def predict(self, classifier: str, clips: DataFrame) -> DataFrame:
        """Scores of clips under a named classifier, long: (file, start_time, end_time, window_id, class, score)."""
        c = self.entries["classifiers"][classifier]
        return store.class_scores(self.embeddings_of(clips).where("embedding is not null"), c["weights"], c["bias"])

    def unlabelled_samples(self, classes: list[str], n: int, seed: int = 0, datasets: list[str] | None = None) -> DataFrame:
        """``n`` clips, in seeded order, of datasets open to training that say nothing of any class."""
        names = [d for d in (datasets or self.datasets()) if self.entries["datasets"][d]["allow_training"]]
        found = None
        for d in names:
            t = self.dataset(d)
            have = [c for c in classes if c in t.columns]
            part = selection.unlabelled(t, have).select(*store.WINDOW_KEY)
            found = part if found is None else found.unionByName(part)
        if found is None:
            raise ValueError("no dataset is open to training")
        return selection.sample(found, store.WINDOW_KEY, n, seed)

    def training_set(self, classes: list[str], datasets: list[str], weak_proportion: float = 0.0, seed: int = 0, weak_weight: float = 0.01) -> DataFrame:
        """Long training rows (file, start_time, end_time, embedding, class, target, weight): labels of the datasets, unknown ones left out, and unlabelled clips as weak negatives."""
        labelled = None
        for d in datasets:
            if not self.entries["datasets"][d]["allow_training"]:
                raise ValueError(f"{d} isn't open to training")
            t = self.dataset(d)
            t = t.select(*store.WINDOW_KEY, *[F.col(c).cast("double") if c in t.columns else F.lit(None).cast("double").alias(c) for c in classes])
            labelled = t if labelled is None else labelled.unionByName(t)
        labelled = labelled.withColumn("__weak", F.lit(False))
        n = int(labelled.count() * weak_proportion)
        if n:
            weak = self.unlabelled_samples(classes, n, seed)
            labelled = labelled.unionByName(weak.withColumns({c: F.lit(0.0) for c in classes} | {"__weak": F.lit(True)}))
        rows = self.embeddings_of(labelled).where("embedding is not null")
        pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("target")) for c in classes])
        return rows.select(*store.WINDOW_KEY, "embedding", "__weak", F.inline(pairs)).where("target is not null").withColumn("weight", F.when(F.col("__weak"), weak_weight).otherwise(1.0)).drop("__weak")


def fit_linear(rows: DataFrame, classes: list[str], steps: int = 200, rate: float = 1.0, decay: float = 1e-4) -> tuple[dict[str, list[float]], dict[str, float]]:
    """Logistic weights per class from long training rows, by accelerated gradient steps whose sums are distributed.

    Each step is one aggregate over the rows: a vector as long as the
    embedding and a number per class come to the driver, whatever the rows.
    """
    import numpy as np
    import pandas as pd

    first = rows.select("embedding").first()
    if first is None:
        raise ValueError("nothing to fit")
    size, at = len(first[0]), {c: i for i, c in enumerate(classes)}
    data = rows.select("embedding", "class", "target", "weight").cache()
    scale = data.select(F.greatest(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))), F.lit(1e-9))).first()[0]
    w, velocity, last = np.zeros((len(classes), size + 1)), np.zeros((len(classes), size + 1)), None

    def gradient(now: np.ndarray) -> np.ndarray:
        def part(batches):
            g = np.zeros((len(classes), size + 2))
            for b in batches:
                x = np.stack([np.asarray(v, dtype=np.float64) for v in b["embedding"]]) / scale
                x = np.hstack([x, np.ones((len(x), 1))])
                k = b["class"].map(at).to_numpy()
                p = 1 / (1 + np.exp(-np.clip((x * now[k]).sum(axis=1), -50, 50)))
                e = (p - b["target"].to_numpy()) * b["weight"].to_numpy()
                np.add.at(g, (k, slice(0, size + 1)), x * e[:, None])
                np.add.at(g, (k, size + 1), b["weight"].to_numpy())
            yield pd.DataFrame({"k": range(len(classes)), "g": list(g)})

        done = data.mapInPandas(part, "k int, g array<double>").select("k", F.posexplode("g").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()  # classes x (size + 2)
        g = np.zeros((len(classes), size + 2))
        for r in done:
            g[r.k, r.i] = r.v
        return g[:, :-1] / np.maximum(g[:, -1:], 1e-9)

    for step in range(steps):
        ahead = w + 0.9 * velocity
        g = gradient(ahead) + decay * ahead
        velocity = 0.9 * velocity - rate * g
        w = w + velocity
        if last is not None and np.abs(velocity).max() < 1e-4:
            break
        last = step
    data.unpersist()
    return {c: (w[i, :-1] / scale).tolist() for c, i in at.items()}, {c: float(w[i, -1]) for c, i in at.items()}


def windows_frame(windows: DataFrame, recordings: DataFrame, deployments: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Windows with their recording's instant and deployment: window_id, file, start_time, end_time, datetime, deployment, project."""
    rec = recordings.select("file", F.col("recorded_at").alias("datetime"), F.col("deployment_id").alias("__d"))
    dep = deployments.select(F.col("deployment_id").alias("__d"), F.col("dep_name").alias("deployment"), "project")
    keys = [k for k in store.WINDOW_KEY]
    return windows.select("window_id", *keys, *extra).join(rec, "file", "left").join(dep, "__d", "left").select("window_id", *keys, "datetime", "deployment", "project", *extra)


def collate(results: DataFrame, windows: DataFrame) -> DataFrame:
    """Search results (window_id, score) with the clip of their window; results are few, so windows aren't shuffled."""
    found = results.select("window_id", "score").join(windows.select("window_id", *store.WINDOW_KEY), "window_id")
    return found.select(*store.WINDOW_KEY, "window_id", F.col("score").alias("sort_score"))
