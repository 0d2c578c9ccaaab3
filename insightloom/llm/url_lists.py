"""The registered filter list of operator 7, in the syntax that ad blockers share.

Families of words stand for what a training corpus can do without: advertising,
tracking, accounts, shops, listings, adult pages and games of chance.  Each family is
written in the forms that such addresses take; exceptions stand at the end.
"""

from __future__ import annotations

ADVERTS = ("ad", "ads", "adserver", "adservice", "adsense", "advert", "adverts", "advertising", "banner", "banners", "popunder", "popup", "promo", "sponsor", "sponsored")
TRACKERS = ("analytics", "beacon", "collector", "metrics", "pixel", "stats", "telemetry", "track", "tracker", "tracking")
ACCOUNTS = ("account", "login", "logout", "password", "register", "signin", "signup")
SHOPS = ("basket", "cart", "checkout", "order-status", "wishlist")
LISTINGS = ("archive", "calendar", "feed", "rss", "search", "sitemap", "tag", "tags")
ADULT = ("adult", "escort", "porn", "sex", "xxx")
CHANCE = ("betting", "casino", "gambling", "jackpot", "lottery", "poker", "slots")
PARAMETERS = ("fbclid", "gclid", "jsessionid", "phpsessid", "replytocom", "sessionid", "sid", "utm_campaign", "utm_medium", "utm_source")
ASSETS = ("css", "gif", "ico", "jpg", "js", "mp3", "mp4", "pdf", "png", "svg", "webp", "woff", "xml", "zip")

EXCEPTIONS = ("@@||docs.*.org^", "@@||archive.org^", "@@/rss/specification/", "@@/search/help/", "@@||developer.*^*/login/", "@@/statistics/stats/")


def lines() -> list[str]:
    """The list, about two hundred rules, one a line."""
    out = []
    for w in (*ADVERTS, *TRACKERS):
        out += [f"||{w}.", f"||{w}-", f"/{w}/", f"/{w}.js|"]
    for w in (*ADULT, *CHANCE):
        out += [f"||{w}.", f"||{w}-", f"-{w}.", f"/{w}/"]
    for w in (*ACCOUNTS, *SHOPS):
        out += [f"/{w}/", f"/{w}|", f"/{w}?", f"/{w}.html"]
    for w in LISTINGS:
        out += [f"/{w}?", f"/{w}/*?page="]
    out += [f"?{p}=" for p in PARAMETERS] + [f"&{p}=" for p in PARAMETERS]
    out += [f".{a}|" for a in ASSETS] + [f".{a}?" for a in ASSETS]
    return [*out, *EXCEPTIONS]
