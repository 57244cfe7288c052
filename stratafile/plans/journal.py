"""What a run of a plan has done so far, on the disk before and after each step.

Where the catalogue lies in a local folder, lines are appended to one file and synced; elsewhere each event is an object of its own, whole once it is there."""

from __future__ import annotations

import json
import os
from datetime import datetime

from ..store import Store


class Journal:
    def __init__(self, store: Store, plan_id: int, of: str = "plan"):
        """of: plan, or rollback."""
        self.store, self.path = store, f"{store.root}/journal/{of}-{plan_id}"
        scheme, _, rest = self.path.partition(":")
        self.local = self.path if "/" in scheme or not rest else "/" + rest.lstrip("/") if scheme == "file" else None
        self.file, self.n = None, 0

    def __enter__(self) -> Journal:
        if self.local:
            os.makedirs(os.path.dirname(self.local), exist_ok=True)
            self.file = open(self.local, "a", encoding="utf-8")  # noqa: SIM115
        return self

    def __exit__(self, *_) -> None:
        if self.file:
            self.file.close()

    def begin(self, step_id: int) -> None:
        self._put({"begin": step_id})

    def end(self, result: dict) -> None:
        self._put({"end": result})

    def _put(self, event: dict) -> None:
        line = json.dumps(event, default=lambda x: x.isoformat()) + "\n"
        if self.file:
            self.file.write(line)
            self.file.flush()
            os.fsync(self.file.fileno())
            return
        self.n += 1
        fs, path = self.store._fs(f"{self.path}/{self.n:09d}.json")
        out = fs.create(path, True)
        try:
            out.write(bytearray(line.encode()))
        finally:
            out.close()

    def _lines(self) -> list[str]:
        if self.local:
            if not os.path.exists(self.local):
                return []
            with open(self.local, encoding="utf-8") as f:
                return f.read().splitlines()
        fs, path = self.store._fs(self.path)
        return [r[0] for r in self.store.spark.read.text(self.path).selectExpr("value", "_metadata.file_name f").orderBy("f").collect()] if fs.exists(path) else []

    def read(self) -> tuple[list[dict], int | None]:
        """(results of the steps that ended, the step that had begun and not ended). A last line that is cut off was not begun or not ended."""
        ended, begun = [], None
        for line in self._lines():
            try:
                event = json.loads(line)
            except ValueError:
                continue
            if "begin" in event:
                begun = event["begin"]
            else:
                ended.append(event["end"] | {"at": datetime.fromisoformat(event["end"]["at"])})
                begun = None
        return ended, begun

    def clear(self) -> None:
        if self.local:
            if os.path.exists(self.local):
                os.remove(self.local)
            return
        fs, path = self.store._fs(self.path)
        fs.delete(path, True)
