"""Repository URLs and links to lines of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.text import forward_slashes

HOST = "github.com"
OWNER, REPO = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?", "[A-Za-z0-9][A-Za-z0-9_.-]{0,98}?"
REF = "^[A-Za-z0-9_./-]{1,250}$"


def canonical_url(url: Column, host: str = HOST) -> Column:
    """``https://host/owner/repo.git``, or null for anything but such an HTTPS address.

    Addresses with login, port, query or fragment are refused; ``www.``, a trailing slash and ``.git`` are not.
    """
    shape = rf"^https://(?i:[w.]*{host.replace('.', '[.]')})/({OWNER})/({REPO})(?:\.git)?/*$"
    u = F.trim(url)
    owner, repo = F.regexp_extract(u, shape, 1), F.regexp_extract(u, shape, 2)
    return F.when(u.rlike(shape) & ~repo.rlike(r"^\.+$"), F.concat(F.lit(f"https://{host}/"), owner, F.lit("/"), repo, F.lit(".git")))


def percent_encoded(part: Column) -> Column:
    """RFC 3986 encoding of one path segment."""
    encoded = F.url_encode(part)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    return encoded


def safe_path(path: Column) -> Column:
    """A relative path of encoded segments without empty, ``.`` and ``..`` ones; null if nothing is left."""
    parts = F.filter(F.split(forward_slashes(path), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.when((F.size(parts) > 0) & ~F.contains(path, F.lit("\0")), F.array_join(F.transform(parts, percent_encoded), "/"))


def source_url(url: Column, path: Column, ref: Column, start: Column, end: Column, host: str = HOST) -> Column:
    """Link to a file at a ref, with ``#Lx`` or ``#Lx-Ly``; null if any part of it is unusable."""
    base = F.regexp_replace(canonical_url(url, host), r"\.git$", "")
    r = F.trim(ref)
    good = r.rlike(REF) & ~r.rlike(r"^\.|\.$|\.\.")
    anchor = F.when(start > 0, F.concat(F.lit("#L"), start, F.when(end > start, F.concat(F.lit("-L"), end)).otherwise("")))
    return F.when(good, F.concat(base, F.lit("/blob/"), r, F.lit("/"), safe_path(path), F.coalesce(anchor, F.lit(""))))
