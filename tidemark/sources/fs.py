"""Small files and the writer's lock, through Spark's own file systems, so that a store can lie wherever Spark writes."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid


class Files:
    def __init__(self, spark, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def local(self, name: str) -> str | None:
        """The path on this machine, where the file system is the local one."""
        full = self._fs.makeQualified(self._path(name)).toUri()
        return full.getPath() if full.getScheme() == "file" else None

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def create(self, name: str, text: str) -> bool:
        """False if the file is there already: of two writers one wins."""
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as e:  # the JVM's classes differ between file systems
            if self.exists(name):
                return False
            raise OSError(str(e)) from None
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def publish(self, name: str, text: str) -> bool:
        """create(), but the file is there whole or not at all: written beside and renamed."""
        if self.exists(name):
            return False
        head, _, tail = name.rpartition("/")
        part = f"{head}/.{tail}.{uuid.uuid4().hex}"
        if not self.create(part, text):
            return False
        if self.exists(name) or not self._fs.rename(self._path(part), self._path(name)):
            self.delete(part)
            return False
        return True

    def read(self, name: str) -> str:
        src = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(src)).decode()
        finally:
            src.close()

    def names(self, name: str = "") -> list[str]:
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else ()
        return sorted(n for n in found if not n.startswith("."))

    def rename(self, name: str, to: str) -> bool:
        return self._fs.rename(self._path(name), self._path(to))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)


class WriterLock:
    """One writer at a time. On a local file system the operating system holds the lock and lets go of it when the process ends;
    elsewhere it is a lease, a file with its holder and an expiry that the holder keeps moving, and that others may take over
    once it has passed."""

    LEASE_S = 60.0

    def __init__(self, files: Files, name: str):
        self.files, self.name, self.owner = files, name, uuid.uuid4().hex
        self._fd, self._stop = None, threading.Event()

    def acquire(self) -> bool:
        path = self.files.local(self.name)
        if path is None:
            return self._lease()
        import fcntl

        os.makedirs(os.path.dirname(path), exist_ok=True)
        fd = os.open(path, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            os.close(fd)
            return False
        self._fd = fd
        return True

    def _text(self) -> str:
        return json.dumps({"owner": self.owner, "expires": time.time() + self.LEASE_S})

    def _read(self, name: str) -> dict:
        try:
            return json.loads(self.files.read(name))
        except Exception:
            return {}

    def _beats(self, owner: str) -> list[str]:
        """The holder's later expiries: files beside the claim, which itself never changes, so that nobody finds it gone."""
        head, _, tail = self.name.rpartition("/")
        return [f"{head}/{n}" for n in self.files.names(head) if n.startswith(f"{tail}.beat-{owner}")]

    def _expires(self) -> float:
        claim = self._read(self.name)
        return max([claim.get("expires", 0), *(self._read(n).get("expires", 0) for n in self._beats(claim.get("owner", "")))])

    def _lease(self) -> bool:
        if not self.files.publish(self.name, self._text()):
            if self._expires() > time.time():
                return False
            # of several that find it expired, one renames it
            if not self.files.rename(self.name, f"{self.name}.expired-{self.owner}") or not self.files.publish(self.name, self._text()):
                return False
            for name in (f"{self.name}.expired-{self.owner}", *self._beats("")):
                self.files.delete(name)
        threading.Thread(target=self._renew, daemon=True).start()
        return self.held()

    def _renew(self) -> None:
        n = 0
        while not self._stop.wait(self.LEASE_S / 4):
            if not self.held():
                return
            n += 1
            self.files.publish(f"{self.name}.beat-{self.owner}-{n}", self._text())
            self.files.delete(f"{self.name}.beat-{self.owner}-{n - 1}")

    def held(self) -> bool:
        """Whether this writer still has the lock; asked before every commit."""
        return self._fd is not None or self._read(self.name).get("owner") == self.owner

    def release(self) -> None:
        self._stop.set()
        if self._fd is not None:
            os.close(self._fd)
            self._fd = None
        elif self.held():
            for name in (*self._beats(self.owner), self.name):
                self.files.delete(name)
