"""Liquidity scores, levels and money in two currencies, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points for how stable a price is.
STABILITY = {"overpaid for": 15, "doing well": 10, "improving": 8, "rising": 8, "stable": 0, "peaking": -3, "fluctuating": -8, "underpaid for": -12, "declining": -12, "dropping": -15, "receding": -15}
LIQUID, MEDIUM = 60, 30


def level(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= LIQUID, "liquid").when(score >= MEDIUM, "medium").otherwise("illiquid")


def item_score(demand: Column, stability: Column, width: Column) -> Column:
    """0 to 100, half to even: demand in tens, points for stability and for the width of the price range."""
    points = F.lit(0)
    for word, n in STABILITY.items():
        points = F.when(F.lower(stability) == word, n).otherwise(points)
    # least and greatest skip nulls, so they are asked for values only
    base = F.when(demand.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(10), demand)) * 10).otherwise(0) + points
    base = base + F.when(width <= 0.05, 5).when(width > 0.2, -5).otherwise(0)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base.cast("double"))), 0)


def offer_score(available: Column, sales: Column, stock: Column, popularity: Column, sold: Column, listed: Column) -> Column:
    """Score of an offer from the first of sales, stock and popularity, then what was sold and listed lately; null if none."""
    capped = lambda n, k: F.when(n.isNotNull(), F.least(F.lit(100.0), k * F.log2(1 + n)))
    first = F.coalesce(capped(sales, 25), capped(stock, 20), 80 * (1 - popularity))
    up = F.when(sold > 0, F.least(F.lit(100.0), F.coalesce(first, F.lit(0.0)) + F.least(F.lit(40), 5 * sold))).otherwise(first)
    net = listed - F.coalesce(sold, F.lit(0))
    down = F.when((listed > 0) & (net > 0) & up.isNotNull(), F.greatest(F.lit(0.0), up - F.least(F.lit(15), 2 * net))).otherwise(up)
    return F.when(~F.coalesce(available, F.lit(True)), F.lit(None)).otherwise(F.bround(down, 0))


def money(usd: Column, rub: Column, exact: Column, native_rub: Column, rate: Column, factor: Column) -> dict[str, Column]:
    """Both currencies of a price and whether each is approximate."""
    rub_only = native_rub | (rub.isNotNull() & (exact | usd.isNull()))
    out_usd = F.when(rub_only, rub / rate).otherwise(usd)
    out_rub = F.when(rub_only, rub).otherwise(F.coalesce(rub, usd * rate))
    return {"usd": out_usd * factor, "usd_approx": rub_only & out_usd.isNotNull(), "rub": out_rub * factor, "rub_approx": ~rub_only & out_rub.isNotNull()}


def back_off(interval: Column, failures: Column, blocked: Column) -> Column:
    """Seconds until the next try: doubled with each failure up to half an hour, at least a quarter if blocked."""
    wait = F.least(F.lit(1800.0), interval * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(5))))
    return F.when(blocked, F.greatest(F.lit(900.0), wait)).otherwise(wait)


#: Orphans that a parse may have (the larger of a number and a share of its items); items from which on a category may not shrink
#: below a share; seconds after which a catalogue is loaded anyway, and after errors.
ORPHANS, ORPHAN_SHARE, SHRINKS, KEPT_SHARE, OLD, RETRY = 2, 0.1, 10, 0.5, 43_200, 900


def parse_verdict(items: Column, orphans: Column, before: Column, imported: Column, repeated: Column) -> Column:
    """Whether a category's parse is taken: not if it is empty, has too many orphans, or shrank; the last is allowed
    where the old items were an import, or where the site gives the same number again. Null counts as 0 or false."""
    zero, no = (lambda c: F.coalesce(c, F.lit(0))), (lambda c: F.coalesce(c, F.lit(False)))
    shrank = (zero(before) >= SHRINKS) & (zero(items) < zero(before) * KEPT_SHARE) & ~no(imported) & ~no(repeated)
    return F.when(zero(items) == 0, "empty").when(zero(orphans) > F.greatest(F.lit(ORPHANS), zero(items) * ORPHAN_SHARE), "orphans").when(shrank, "shrank").otherwise("taken")


def refresh_reason(paused: Column, items: Column, age: Column, errors: Column, site_date: Column, own_date: Column) -> Column:
    """Why a catalogue is loaded again, the first that holds: paused (not at all), empty, old, errors, no date, changed; else same."""
    return (
        F.when(paused, "paused").when(items == 0, "empty").when(age.isNull() | (age > OLD), "old").when((errors > 0) & (age >= RETRY), "errors")
        .when(site_date.isNull(), "no date").when(~site_date.eqNullSafe(own_date), "changed").otherwise("same")
    )


def banner_category(r: Column, g: Column, b: Column) -> Column:
    """Category by the hue of a banner; null if unknown."""
    top, low = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    d = (F.greatest(r, g, b) - F.least(r, g, b)).cast("double")
    hue = F.when(d == 0, 0.0).when(F.greatest(r, g, b) == r, F.pmod(60.0 * (g - b) / d, F.lit(360.0))).when(F.greatest(r, g, b) == g, 60.0 * (b - r) / d + 120).otherwise(60.0 * (r - g) / d + 240)
    named = F.when((hue >= 40) & (hue < 70), "vintages").when((hue >= 275) & (hue < 335), "godlies").when((hue >= 335) | (hue < 15), "legendaries").when((hue >= 185) & (hue < 255), "rares").when((hue >= 85) & (hue < 165), "uncommons")
    return F.when(top - low < 0.12, F.when(top > 0.55, "commons")).otherwise(named)
