"""Identities and ordered credits as arrays. An identity is (provider, kind, external_id); a credit is (name, join_phrase, identities)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import normalize_album_title

IDENTITY = "struct<provider:string,kind:string,external_id:string>"
CREDIT = f"struct<name:string,join_phrase:string,identities:array<{IDENTITY}>>"


def _key(name: Column) -> Column:
    """Composed names only: inside lambdas there is no NFC."""
    return normalize_album_title(name, composed=False)


def _namespace(x: Column, y: Column) -> Column:
    return (x["provider"] == y["provider"]) & (x["kind"] == y["kind"])


def credit_conflict(a: Column, b: Column) -> Column:
    """A namespace that both have, without one identity in common in it."""
    return F.exists(a, lambda x: F.exists(b, lambda y: _namespace(x, y)) & ~F.exists(a, lambda s: _namespace(s, x) & F.array_contains(b, s)))


def occurrence_conflict(a: Column, b: Column) -> Column:
    """An identity of a that b lacks, in a namespace that b has: stricter than credit_conflict."""
    return F.exists(a, lambda x: F.exists(b, lambda y: _namespace(x, y)) & ~F.array_contains(b, x))


def edition_conflict(a: Column, b: Column) -> Column:
    """Two complete identities of one namespace that differ, whatever else is shared: the strictest."""
    whole = lambda x: (x["provider"] != "") & (x["kind"] != "") & (x["external_id"] != "")
    return F.exists(a, lambda x: F.exists(b, lambda y: whole(x) & whole(y) & _namespace(x, y) & (x["external_id"] != y["external_id"])))


def shared_identity(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def trusted_overlap(a: Column, b: Column) -> Column:
    """Some known artist identity in common and no conflict."""
    return ~credit_conflict(a, b) & F.exists(a, lambda x: (x["kind"] == "artist") & (x["external_id"] != "") & F.array_contains(b, x))


def keyed(credits: Column) -> Column:
    """Credits with comparison keys for names. Select this first where credits are compared several times."""
    return F.transform(credits, lambda c: F.struct(_key(c["name"]).alias("name"), c["identities"].alias("identities")))


def same_artist(a: Column, b: Column) -> Column:
    """Two keyed credits: an identity in common or the same name, and no conflict."""
    named = (a["name"] != "") & (a["name"] == b["name"])
    return (named | F.arrays_overlap(a["identities"], b["identities"])) & ~credit_conflict(a["identities"], b["identities"])


def compare_credits(a: Column, b: Column) -> Column:
    """Of keyed credits: unspecified, contradictory, equivalent, incomplete (one omits credits) or different_additional."""
    every = lambda x, y: F.forall(x, lambda p: F.exists(y, lambda q: same_artist(p, q)))
    extra = lambda x, y: F.filter(F.slice(x, 2, 1000), lambda p: ~F.exists(y, lambda q: same_artist(p, q)))
    clash = F.exists(extra(a, b), lambda p: F.exists(extra(b, a), lambda q: credit_conflict(p["identities"], q["identities"])))
    left, right = every(a, b), every(b, a)
    return (
        F.when((F.size(a) < 1) | (F.size(b) < 1), "unspecified")
        .when(~same_artist(F.get(a, F.lit(0)), F.get(b, F.lit(0))), "contradictory")
        .when(left & right, "equivalent").when(left | right, "incomplete").when(clash, "contradictory").otherwise("different_additional")
    )


def credit_text(credits: Column, between: str = "") -> Column:
    """Names with their join phrases, in order."""
    return F.aggregate(credits, F.lit(""), lambda t, c: F.concat(t, c["name"], F.coalesce(c["join_phrase"], F.lit(between))))


def musical_title(title: Column, names: Column) -> Column:
    """Without a trailing (feat. ...) that names exactly the credits after the first."""
    open_at = F.regexp_extract(F.trim(title), r"(?s)^(.*) \(([^)]*(?:\)(?!$)[^)]*)*)\)$", 1)
    inside = _key(F.regexp_extract(F.trim(title), r"(?s)^.* \((.*)\)$", 1))
    credited = F.regexp_replace(inside, r"^(?:feat\. |featuring )", "")
    rest = F.transform(F.slice(names, 2, 1000), _key)
    explained = (F.size(names) >= 2) & (credited != inside) & ~F.exists(rest, lambda n: n == "") & credited.isin(F.array_join(rest, ", "), F.array_join(rest, " & "), F.array_join(rest, " and "))
    return F.when(explained, open_at).otherwise(title)
