"""Plain-Python versions of the URL and page features, for brute-force checks.

These follow the documented semantics directly (stdlib ``urlparse``, a
dynamic-programming edit distance, stdlib ``html.parser``) and share no code
with the Spark jobs.
"""

from __future__ import annotations

import re
import urllib.parse
from html.parser import HTMLParser

from hookline.fixed import BRANDS


def edit_distance(a: str, b: str) -> int:
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def url_features(url: str) -> dict:
    p = urllib.parse.urlparse(url)
    f = {"url_length": len(url), "domain_length": len(p.netloc), "path_length": len(p.path)}
    for name, ch in [("at_count", "@"), ("double_slash_count", "//"), ("dash_count", "-"),
                     ("dot_count", "."), ("underscore_count", "_"), ("question_count", "?"),
                     ("equal_count", "="), ("ampersand_count", "&"), ("exclamation_count", "!"),
                     ("tilde_count", "~"), ("comma_count", ","), ("plus_count", "+"),
                     ("asterisk_count", "*"), ("hash_count", "#"), ("dollar_count", "$"),
                     ("percent_count", "%")]:
        f[name] = url.count(ch)
    f["space_count"] = url.count(" ") + url.count("%20")
    f["has_https"] = 1.0 if p.scheme == "https" else 0.0
    f["https_in_domain"] = 1.0 if "https" in p.netloc.lower() else 0.0
    host = p.netloc.split(":")[0]
    f["has_ip_address"] = 1.0 if re.match(r"^(\d{1,3}\.){3}\d{1,3}$", host) else 0.0
    f["ip_in_url"] = 1.0 if re.search(r"(\d{1,3}\.){3}\d{1,3}", url) else 0.0
    d = host[4:] if host.startswith("www.") else host
    f["num_subdomains"] = max(0, len(d.split(".")) - 2)
    f["has_www"] = 1.0 if p.netloc.startswith("www.") else 0.0
    lab = p.netloc.lower().split(":")[0]
    lab = lab[4:] if lab.startswith("www.") else lab
    parts = lab.split(".")
    lab = parts[-2] if len(parts) > 2 else parts[0] if len(parts) == 2 else lab
    best, brand = None, None
    for b in BRANDS:
        dist = edit_distance(lab, b)
        if best is None or dist < best:
            best, brand = dist, b
    f["levenshtein_distance"] = float(best)
    f["normalized_levenshtein"] = best / max(len(lab), 1)
    f["typosquatting_score"] = 1.0 if best <= 2 and len(lab) > 3 else 0.0
    f["closest_brand"] = brand
    return f


class _Collect(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tags = []

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.tags.append((tag, attrs))


def page_features(url: str, html: str | None) -> dict:
    out = {"has_form": 0.0, "has_password_field": 0.0, "num_external_links": 0.0,
           "num_images": 0.0, "favicon_from_other_domain": 0.0}
    if html is None:
        return out
    c = _Collect()
    c.feed(html)
    c.close()
    base = urllib.parse.urlparse(url).netloc

    def attr(attrs, name):
        return dict(attrs).get(name)  # of several, a parsed dictionary holds the last

    def external(href):
        return href is not None and href.startswith("http") and base not in href

    tags = c.tags
    out["has_form"] = 1.0 if any(t == "form" for t, _ in tags) else 0.0
    out["has_password_field"] = 1.0 if any(t == "input" and attr(a, "type") == "password" for t, a in tags) else 0.0
    out["num_external_links"] = float(sum(1 for t, a in tags if t == "a" and external(attr(a, "href"))))
    out["num_images"] = float(sum(1 for t, _ in tags if t == "img"))
    for t, a in tags:
        rel = attr(a, "rel")
        if t == "link" and rel is not None and "icon" in rel.split():
            out["favicon_from_other_domain"] = 1.0 if external(attr(a, "href")) else 0.0
            break
    return out
