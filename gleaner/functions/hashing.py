"""Digest of a posting's content in one canonical form, whatever the order of keys, the spaces and the nesting."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.urls import canonical

#: Fixed value: the fields whose change is a change of the posting.
CONTENT = ("title", "employer", "location", "description", "employment_type", "salary", "apply_url", "remote", "workplace_type", "listing_language")
MOST_TEXT = 2_000_000


def _plain(x: object) -> object:
    """Texts with single spaces, blank ones null; lists and objects all the way down. Keys are put in order on writing."""
    if isinstance(x, str):
        return " ".join(x.replace("\x00", " ")[:MOST_TEXT].split()) or None
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _opened(x: object) -> object:
    """A member that holds JSON of an object or a list as text, as what it holds."""
    if isinstance(x, str) and x.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(x)
        except ValueError:
            return x
    return x


def digest(text: str | None, nested: tuple[str, ...] = ()) -> str | None:
    if text is None:
        return None
    row = json.loads(text)
    row = _plain({k: _opened(v) if k in nested else v for k, v in row.items()})
    return hashlib.sha256(json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "replace")).hexdigest()


@F.pandas_udf(T.StringType())
def _digests(rows: pd.Series) -> pd.Series:
    return rows.map(lambda t: digest(t, ("salary",)), na_action="ignore")


def content_digest(**fields: Column) -> Column:
    """SHA-256 of the CONTENT fields (missing ones null): sorted keys, texts folded, numbers as written, application URL canonical.

    salary may be text, a number, or JSON of an object or list. A URL that has no canonical form stays as it is.
    """
    unknown = set(fields) - set(CONTENT)
    if unknown:
        raise ValueError(f"no content fields: {', '.join(sorted(unknown))}")
    got = {name: fields.get(name, F.lit(None).cast("string")) for name in CONTENT}
    url = got["apply_url"]
    got["apply_url"] = F.coalesce(canonical(url), url)
    return _digests(F.to_json(F.struct(*[c.alias(n) for n, c in got.items()]), {"ignoreNullFields": "false"}))
