"""Fetching sources: pinned git commits and archives, into folders named by project and commit.

:func:`fetch_all` fetches each checkout in a task, into a folder that all executors share."""

from __future__ import annotations

import re
import shutil
import subprocess
import tarfile
import tempfile
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..schemas import CHECKOUT

_ARCHIVE = re.compile(r"\.(tar\.gz|tgz|tar\.bz2|tar\.xz|tar)$", re.I)


def folder_name(project: str, commit: str | None) -> str:
    """The same name as functions.text.checkout_key gives."""
    clean = lambda s: re.sub(r"[^A-Za-z0-9._-]", "_", s)
    return clean(project) + (f"__{clean(commit[:12])}" if commit else "")


def git(*args: str, at: Path | None = None) -> str:
    where = ["-C", str(at), "-c", f"safe.directory={at}"] if at else []
    return subprocess.run(["git", *where, *args], check=True, capture_output=True, text=True).stdout.strip()


def checkout(url: str, commit: str | None, dest: Path, force: bool = False, blobless: bool = False) -> str:
    """Clones url to dest if it isn't there and puts it at commit; returns the commit that is checked out, which must be the one asked for."""
    if force and dest.exists():
        shutil.rmtree(dest)
    if not (dest / ".git").exists():
        git("clone", *(["--filter=blob:none"] if blobless else []), "--no-checkout" if commit else "--quiet", url, str(dest))
    if commit:
        git("checkout", "--quiet", "--force", commit, at=dest)
    head = git("rev-parse", "HEAD", at=dest)
    if commit and head != git("rev-parse", f"{commit}^{{commit}}", at=dest):
        raise RuntimeError(f"{dest} is at {head}, not {commit}")
    return head


def unpack(archive: Path, dest: Path) -> None:
    """Members that would leave dest are refused; a single top folder is dropped."""
    dest.mkdir(parents=True, exist_ok=True)
    with tarfile.open(archive) as tar:
        tar.extractall(dest, filter="data")
    inside = list(dest.iterdir())
    if len(inside) == 1 and inside[0].is_dir():
        for p in inside[0].iterdir():
            shutil.move(str(p), dest / p.name)
        inside[0].rmdir()


def fetch(project: str, url: str, commit: str | None, root: Path, force: bool = False, blobless: bool = False) -> dict:
    """A row of the checkout manifest; a failure is a row that says so."""
    dest = root / folder_name(project, commit)
    archive = bool(_ARCHIVE.search(url.rstrip("/")))
    row = {"project": project, "url": url, "commit": commit, "dest": str(dest), "type": "tarball" if archive else "git", "checked_out_commit": None, "ok": True}
    try:
        if not archive:
            row["checked_out_commit"] = checkout(url, commit, dest, force, blobless)
        elif force or not dest.exists():
            shutil.rmtree(dest, ignore_errors=True)
            with tempfile.NamedTemporaryFile(suffix=Path(url).name) as archive_file:
                with urllib.request.urlopen(url) as reply:
                    shutil.copyfileobj(reply, archive_file)
                archive_file.flush()
                unpack(Path(archive_file.name), dest)
    except Exception as e:  # noqa: BLE001  the row tells it
        row |= {"ok": False, "error": f"{type(e).__name__}: {e}"}
    return row


def fetch_all(checkouts: DataFrame, root: str, force: bool = False, blobless: bool = False, tasks: int = 8) -> DataFrame:
    """Rows of the checkout manifest, with the ordinals of checkouts (project, url, commit, ordinal). The result is to be stored: reading
    it again fetches again, though what is there stays."""
    schema = T.StructType([*CHECKOUT.fields, T.StructField("ordinal", T.LongType())])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [{"error": None, **fetch(r.project, r.url, r.commit if isinstance(r.commit, str) else None, Path(root), force, blobless), "ordinal": r.ordinal} for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=schema.names)

    return checkouts.select("project", "url", "commit", "ordinal").repartition(tasks, "project", "url", "commit").mapInPandas(run, schema)


def files_of(checkouts: DataFrame) -> DataFrame:
    """(repo_root, path) of all files of checkouts that are ok."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(dest, str(p.relative_to(dest))) for dest in pdf["repo_root"] for p in Path(dest).rglob("*") if p.is_file() and ".git" not in p.relative_to(dest).parts]
            yield pd.DataFrame(rows, columns=["repo_root", "path"])

    return checkouts.where("ok").selectExpr("dest AS repo_root").distinct().mapInPandas(run, "repo_root string, path string")
