"""One holder at a time, across drivers: numbered lease files in a shared folder.

The newest file says who holds the lease and until when. To take a free or expired lease is to create the next
number only if it is absent, so of several that try at once one gets it; a release is one more file, without a
holder. Times are the drivers' clocks, so a lease should last much longer than these differ. Who outlives the lease has
lost it as soon as another took it, and must ask ``held`` before making its work count.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

from .appendlog import create_if_absent, qualified, read_text


class Lease:
    def __init__(self, spark: SparkSession, root: str, seconds: float):
        self.spark, self.root, self.seconds = spark, root.rstrip("/"), seconds
        self.owner = uuid.uuid4().hex

    def _newest(self) -> tuple[int, dict]:
        files, folder = qualified(self.spark, self.root)
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        last = max((int(n) for n in names if n.isdigit()), default=-1)
        return last, json.loads(read_text(self.spark, self._file(last))) if last >= 0 else {"owner": None, "until": 0}

    def _file(self, number: int) -> str:
        return f"{self.root}/{number:020d}"

    def take(self) -> bool:
        """Whether the lease was free and is now this one's."""
        last, now = self._newest()
        if now["owner"] and now["until"] > time.time():
            return False
        return create_if_absent(self.spark, self._file(last + 1), json.dumps({"owner": self.owner, "until": time.time() + self.seconds}))

    def held(self) -> bool:
        """Whether no one took the lease since, though its time may be over."""
        return self._newest()[1]["owner"] == self.owner

    def release(self) -> None:
        last, now = self._newest()
        if now["owner"] == self.owner:
            create_if_absent(self.spark, self._file(last + 1), json.dumps({"owner": None, "until": 0}))
