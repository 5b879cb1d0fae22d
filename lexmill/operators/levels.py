"""Tables that grow by small appends and stay few folders: merged by levels, with a manifest of what is live.

Every append is a folder of its own, so writers do not meet. ``compact`` merges a
level's folders into one of the next level once there are enough of them: after
n appends a read touches some multiple of log n folders. A merge becomes visible
by its manifest alone, which is put under the next number if nobody else has put
one there; the folders it replaced go one manifest later, when readers that still
had the old one are done. A writer may stop anywhere: what it left undone changes
no row that is read, and the next merge clears it away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lexmill.session import delete_path, list_names, put_if_absent, read_text

#: This many folders of one level become one of the next.
FAN = 8
#: Manifests that are kept.
KEPT_MANIFESTS = 3


@dataclass
class Manifest:
    """Merged folders by level, the appends they hold that may still lie there, and what the next manifest may delete."""

    number: int = 0
    merged: list[tuple[int, str]] = field(default_factory=list)
    covered: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)


class LevelledTable:
    """A table below one folder: appends in ``<prefix>=<name>``, merges and manifests in folders that Spark's readers skip."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        combine: Callable[[DataFrame], DataFrame] | None = None,
        prefix: str = "batch",
        fan: int = FAN,
    ) -> None:
        self.spark, self.schema, self.prefix, self.fan = spark, schema, prefix, fan
        self.root = root.rstrip("/")
        #: What a merge does to the rows of its folders; as they are where it is unset.
        self.combine = combine

    def append(self, rows: DataFrame, name: str | None = None) -> None:
        """Write rows as one append; the same name again replaces it, unless a merge holds it already."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{self.prefix}={name or uuid.uuid4().hex}")

    def manifest(self) -> Manifest:
        numbers = sorted(int(n.split(".")[0]) for n in list_names(self.spark, f"{self.root}/_manifest") if n.endswith(".json"))
        if not numbers:
            return Manifest()
        read = json.loads(read_text(self.spark, f"{self.root}/_manifest/{numbers[-1]:08d}.json"))
        return Manifest(numbers[-1], [tuple(m) for m in read["merged"]], read["covered"], read["dropped"])

    def _appended(self) -> list[str]:
        return sorted(n for n in list_names(self.spark, self.root) if n.startswith(f"{self.prefix}="))

    def _open(self, manifest: Manifest) -> list[str]:
        """Finished appends that no merge holds."""
        held = set(manifest.covered)
        names = [n for n in self._appended() if n not in held]
        return [n for n in names if "_SUCCESS" in list_names(self.spark, f"{self.root}/{n}")]

    def folders(self) -> list[str]:
        """The live folders, merged ones first."""
        manifest = self.manifest()
        merged = [f"{self.root}/_merged/{name}" for _, name in manifest.merged]
        return merged + [f"{self.root}/{name}" for name in self._open(manifest)]

    def read(self) -> DataFrame:
        """All rows; an empty table where nothing was appended."""
        live = self.folders()
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*live)

    def compact(self) -> bool:
        """Merge what has enough folders; false where there was nothing to do or another merge came first."""
        manifest = self.manifest()
        appends = self._open(manifest)
        if len(appends) < self.fan:
            return False
        sources, names, level = [f"{self.root}/{name}" for name in appends], [], 1
        merged = list(manifest.merged)
        # A full level goes along into the next one, so that rows are read once.
        while len([m for m in merged if m[0] == level]) + 1 >= self.fan:
            full = [name for at, name in merged if at == level]
            sources += [f"{self.root}/_merged/{name}" for name in full]
            names += full
            merged = [m for m in merged if m[0] != level]
            level += 1
        target = uuid.uuid4().hex
        try:
            rows = self.spark.read.schema(self.schema).parquet(*sources)
            rows = self.combine(rows) if self.combine else rows.coalesce(1 + len(sources) // (4 * self.fan))
            rows.write.parquet(f"{self.root}/_merged/{target}")
        except Exception:
            # Later merges may have taken the folders away while this one read them.
            if self.manifest().number == manifest.number:
                raise
            delete_path(self.spark, f"{self.root}/_merged/{target}")
            return False
        # An append of before may be replayed, or outlive a merge that was cut short: its name stays held while it lies there.
        held = set(manifest.covered)
        lingering = [n for n in self._appended() if n in held]
        old = [f"{self.root}/{n}" for n in appends] + [f"{self.root}/_merged/{n}" for n in names]
        following = {"merged": [*merged, (level, target)], "covered": [*appends, *lingering], "dropped": old}
        number = manifest.number + 1
        if not put_if_absent(self.spark, f"{self.root}/_manifest/{number:08d}.json", json.dumps(following)):
            delete_path(self.spark, f"{self.root}/_merged/{target}")
            return False
        for path in {*manifest.dropped, *(f"{self.root}/{n}" for n in lingering)}:
            delete_path(self.spark, path)
        if number > KEPT_MANIFESTS:
            delete_path(self.spark, f"{self.root}/_manifest/{number - KEPT_MANIFESTS:08d}.json")
        return True
