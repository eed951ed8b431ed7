"""What a private release leaves behind on the driver: a ledger that spends each domain once, and seals of its files."""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
from fractions import Fraction


class Ledger:
    """Reservations by domain in a SQLite file. A domain is reserved once; what is spent is never given back."""

    def __init__(self, path: str):
        self.db = sqlite3.connect(path, isolation_level=None)
        self.db.execute("CREATE TABLE IF NOT EXISTS spent (domain TEXT PRIMARY KEY, release TEXT NOT NULL, epsilon TEXT NOT NULL, sealed TEXT)")

    def reserve(self, domain: str, release: str, epsilon: Fraction) -> None:
        """Before any noise is drawn. A second reservation of a domain is an error, also by the same release."""
        if epsilon <= 0:
            raise ValueError("a budget is positive")
        try:
            self.db.execute("INSERT INTO spent VALUES (?, ?, ?, NULL)", (domain, release, str(Fraction(epsilon))))
        except sqlite3.IntegrityError:
            raise ValueError(f"the budget of {domain!r} is spent") from None

    def seal(self, domain: str, files: list[str]) -> str:
        """Hashes of the release's files, kept with the reservation; sealed once."""
        said = sealed(files)
        done = self.db.execute("UPDATE spent SET sealed = ? WHERE domain = ? AND sealed IS NULL", (said, domain)).rowcount
        if done != 1:
            raise ValueError(f"{domain!r} is not reserved, or sealed already")
        return said

    def verify(self, domain: str, files: list[str]) -> bool:
        row = self.db.execute("SELECT sealed FROM spent WHERE domain = ?", (domain,)).fetchone()
        return row is not None and row[0] == sealed(files)

    def total(self) -> Fraction:
        return sum((Fraction(x) for (x,) in self.db.execute("SELECT epsilon FROM spent")), Fraction(0))


def sealed(files: list[str]) -> str:
    """JSON of names and SHA-256 hashes, in order of name."""
    out = {}
    for path in files:
        with open(path, "rb") as f:
            out[os.path.basename(path)] = hashlib.file_digest(f, "sha256").hexdigest()
    return json.dumps(out, sort_keys=True)


def chained(before: str, step: dict) -> str:
    """Hash of a step of a release's history over that of the steps before it."""
    return hashlib.sha256(f"{before}|{json.dumps(step, sort_keys=True)}".encode()).hexdigest()
