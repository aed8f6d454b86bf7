"""Manifests: which files a run made, with digests, sizes and a digest of the whole."""

from __future__ import annotations

import json
import re
import shutil
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

FORMAT, FORMAT_VERSION, ALGORITHM = "weftmap metadata", "1.0", "XXH3 (128 bits)"
SAMPLE = 512 << 20
UNFINISHED = "0" * 32


def hash_file(path: str | Path, sample: int = SAMPLE) -> str:
    """XXH3-128 of a file; of a larger one its head, half of the sample, and its tail, the rest."""
    import xxhash

    if sample < 1:
        raise ValueError("the sample must be greater than zero")
    path = Path(path)
    size = path.stat().st_size
    head = size if sample >= size else max(sample // 2, 1)
    stretches = [(0, head)] if sample >= size else [(0, head), (size - (sample - head), sample - head)]
    state = xxhash.xxh3_128()
    with path.open("rb") as file:
        for at, left in stretches:
            file.seek(at)
            while left and (chunk := file.read(min(left, 4 << 20))):
                state.update(chunk)
                left -= len(chunk)
    return state.hexdigest()


def is_digest(text: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-f]{32}", text))


@dataclass(order=True)
class Record:
    name: str
    digest: str
    size: int


@dataclass
class Validation:
    finalized: bool = False
    expected: str = ""
    computed: str = ""
    records: int = 0
    report_failures: list[str] = field(default_factory=list)
    record_failures: dict[str, str] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return self.finalized and not self.report_failures and not self.record_failures

    def raise_failures(self) -> None:
        if not self:
            found = [*([] if self.finalized else ["the report was never finalized"]), *self.report_failures, *(f"{n}: {why}" for n, why in self.record_failures.items())]
            raise ValueError("invalid report: " + "; ".join(found[:10]) + (f"; and {len(found) - 10} more" if len(found) > 10 else ""))


@dataclass
class Manifest:
    """A report about files in a folder. It is finalized once all files are in place and their digests hold."""

    path: Path
    created_by: str = "weftmap"
    sample: int = SAMPLE
    records: list[Record] = field(default_factory=list)
    digest: str = UNFINISHED
    algorithm: str = ALGORITHM
    format: str = FORMAT
    format_version: str = FORMAT_VERSION
    creation_time: str = field(default_factory=lambda: datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S"))
    finalized: bool = False

    @classmethod
    def create(cls, path: str | Path, force: bool = False, **more) -> Manifest:
        path = Path(path)
        if path.exists() and not force:
            raise FileExistsError(f"{path} already exists")
        path.parent.mkdir(parents=True, exist_ok=True)
        made = cls(path, **more)
        made._write()
        return made

    @classmethod
    def load(cls, path: str | Path, strict: bool = True) -> Manifest:
        path = Path(path)
        raw = json.loads(path.read_text())
        names = {"format": "format", "format-version": "format_version", "created-by": "created_by", "creation-time": "creation_time", "digest": "digest", "digest-algorithm": "algorithm", "digest-sample-size": "sample"}
        if strict and (missing := [k for k in [*names, "records"] if k not in raw]):
            raise ValueError(f"{path} has no {', '.join(missing)}")
        found = cls(path, **{v: raw[k] for k, v in names.items() if k in raw})
        found.records = sorted(Record(r["name"], r["digest"], r["size"]) for r in raw.get("records", []))
        found.finalized = found.digest != UNFINISHED
        return found

    def checksum(self) -> str:
        """Digest of the report: its own fields in alphabetic order, then the records by name."""
        import xxhash

        state = xxhash.xxh3_128()
        for part in (self.created_by, self.algorithm, str(self.sample), self.format_version):
            state.update(part)
        for r in sorted(self.records):
            for part in (r.name, r.digest, str(r.size)):
                state.update(part)
        return state.hexdigest()

    def register(self, path: str | Path) -> Record:
        path = Path(path)
        if not path.is_file():
            raise FileNotFoundError(f"{path} doesn't exist or isn't a regular file")
        name = str(path.resolve().relative_to(self.path.parent.resolve()))
        if any(r.name == name for r in self.records):
            raise ValueError(f"{name} has already been registered")
        record = Record(name, hash_file(path, self.sample), path.stat().st_size)
        self.records = sorted([*self.records, record])
        return record

    def move_and_register(self, path: str | Path, name: str | None = None) -> Record:
        """Move a file into the folder, by a rename where that works, else by a copy."""
        path = Path(path)
        target = self.path.parent / (name or path.name)
        if target.exists():
            raise FileExistsError(f"{target} already exists")
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.move(path, target)
        return self.register(target)

    def finalize(self) -> None:
        """Hash all files again and write the report with its digest."""
        if self.finalized:
            raise RuntimeError("the report has been finalized already")
        if bad := self._check_files():
            raise ValueError("; ".join(f"{n}: {why}" for n, why in bad.items()))
        self.digest = self.checksum()
        self.finalized = True
        self._write()

    def validate(self, threads: int = 4) -> Validation:
        found = Validation(finalized=self.digest != UNFINISHED, records=len(self.records))
        if self.format != FORMAT:
            found.report_failures.append(f"unrecognized format {self.format!r}")
        if self.algorithm != ALGORITHM:
            found.report_failures.append(f"unrecognized digest-algorithm {self.algorithm!r}")
        if not self.sample:
            found.report_failures.append("digest-sample-size cannot be 0")
        if not is_digest(self.digest):
            found.report_failures.append("the digest isn't one")
        if not found:
            return found
        found.expected, found.computed = self.digest, self.checksum()
        if found.expected != found.computed:
            found.report_failures.append(f"checksum mismatch: expected {found.expected}, found {found.computed}")
        found.record_failures = self._check_files(threads)
        return found

    def _check_files(self, threads: int = 4) -> dict[str, str]:
        def why(r: Record) -> str:
            path = self.path.parent / r.name
            if not path.exists():
                return "file does not exist"
            if (size := path.stat().st_size) != r.size:
                return f"file size mismatch: expected {r.size}, found {size}"
            if (digest := hash_file(path, self.sample)) != r.digest:
                return f"checksum mismatch: expected {r.digest}, found {digest}"
            return ""

        with ThreadPoolExecutor(threads) as pool:
            return {r.name: w for r, w in zip(self.records, pool.map(why, self.records)) if w}

    def _write(self) -> None:
        report = {
            "format": self.format, "format-version": self.format_version, "created-by": self.created_by, "creation-time": self.creation_time,
            "digest": self.digest, "digest-algorithm": self.algorithm, "digest-sample-size": self.sample,
            "records": [{"name": r.name, "digest": r.digest, "size": r.size} for r in self.records],
        }
        self.path.write_text(json.dumps(report, indent=2))


def checksum(path: str | Path) -> tuple[str, bool]:
    """(digest, whether it is what a report says): a report's own digest, else that of the file."""
    path = Path(path)
    if path.suffix == ".json":
        try:
            report = Manifest.load(path, strict=False)
            if report.records or report.digest != UNFINISHED:
                return report.checksum(), report.checksum() == report.digest
        except (ValueError, KeyError, TypeError):
            pass
    return hash_file(path), True
