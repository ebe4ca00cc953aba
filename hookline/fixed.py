"""Fixed values that results depend on.

Everything in this module is a plain constant: lists, names, thresholds and
texts whose exact values (and, where noted, order) decide the output of the
feature, label, rule and model jobs. Nothing here is computed.
"""

from __future__ import annotations

# --- FIXED VALUES (must stay exactly as written; order matters) -------------

# Brand list for the typosquatting features. List order breaks distance ties:
# the first brand with the minimum distance wins.
BRANDS = [
    "google", "facebook", "amazon", "paypal", "apple", "microsoft",
    "netflix", "gmail", "yahoo", "linkedin", "twitter", "instagram",
    "bankofamerica", "chase", "wellsfargo", "citibank", "amex",
    "dropbox", "github", "spotify", "uber", "airbnb",
]

# The 32 model features, in vector order.
FEATURE_COLUMNS = [
    "url_length", "domain_length", "path_length",
    "at_count", "double_slash_count", "dash_count", "dot_count",
    "underscore_count", "question_count", "equal_count", "ampersand_count",
    "exclamation_count", "space_count", "tilde_count", "comma_count",
    "plus_count", "asterisk_count", "hash_count", "dollar_count",
    "percent_count",
    "has_https", "https_in_domain", "has_valid_ssl",
    "has_ip_address", "ip_in_url",
    "num_subdomains", "has_www",
    "domain_age_days", "domain_registration_length",
    "levenshtein_distance", "normalized_levenshtein", "typosquatting_score",
]

# Single-character counts over the raw url: feature name -> character.
CHAR_COUNTS = [
    ("at_count", "@"),
    ("dash_count", "-"),
    ("dot_count", "."),
    ("underscore_count", "_"),
    ("question_count", "?"),
    ("equal_count", "="),
    ("ampersand_count", "&"),
    ("exclamation_count", "!"),
    ("tilde_count", "~"),
    ("comma_count", ","),
    ("plus_count", "+"),
    ("asterisk_count", "*"),
    ("hash_count", "#"),
    ("dollar_count", "$"),
    ("percent_count", "%"),
]

# Page-content features (off in the default feature vector).
CONTENT_COLUMNS = [
    "has_form", "has_password_field", "num_external_links", "num_images",
    "favicon_from_other_domain",
]

# Schemes whose last path segment drops ";params" (Python's urlparse list).
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
    "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
]

# Characters whose compatibility form (NFKC) holds one of / ? # @ : and so may not stand in a host.
HOST_UNSAFE_CHARACTERS = "⁇⁈⁉℀℁℅℆⩴︓︖﹕﹖﹟﹫＃／：？＠"

# Error texts of hosts that Python's url parser refuses.
ERROR_BRACKETS = "Invalid IPv6 URL"
ERROR_FUTURE_ADDRESS = "IPvFuture address is invalid"
ERROR_IPV4_IN_BRACKETS = "An IPv4 address cannot be in brackets"
ERROR_NO_ADDRESS = "'{host}' does not appear to be an IPv4 or IPv6 address"
ERROR_HOST_CHARACTERS = "netloc '{netloc}' contains invalid characters under NFKC normalization"

# Label text (lower-cased, untrimmed) that counts as phishing in custom CSVs.
CUSTOM_POSITIVE_LABELS = ["phishing", "1", "malicious", "bad", "true"]

# Target values that count as phishing in UCI-style files (numbers and text).
UCI_POSITIVE_NUMBERS = [1, -1]
UCI_POSITIVE_TEXT = ["1", "phishing", "-1"]

# Target column preference for UCI-style files; else the last column.
UCI_TARGET_NAMES = ["Result", "class"]

# The 30 attribute names of the UCI phishing-websites table.
UCI_FEATURE_NAMES = [
    "having_IP_Address", "URL_Length", "Shortining_Service",
    "having_At_Symbol", "double_slash_redirecting", "Prefix_Suffix",
    "having_Sub_Domain", "SSLfinal_State", "Domain_registeration_length",
    "Favicon", "port", "HTTPS_token", "Request_URL", "URL_of_Anchor",
    "Links_in_tags", "SFH", "Submitting_to_email", "Abnormal_URL",
    "Redirect", "on_mouseover", "RightClick", "popUpWidnow", "Iframe",
    "age_of_domain", "DNSRecord", "web_traffic", "Page_Rank",
    "Google_Index", "Links_pointing_to_page", "Statistical_report",
]

# Warning rules of the scoring report, in output order.
WARN_NO_HTTPS = "- No HTTPS"
WARN_IP = "- Contains IP address"
WARN_TYPOSQUAT = "- Possible typosquatting of '{brand}'"
WARN_NEW_DOMAIN = "- Domain is less than 30 days old"
NEW_DOMAIN_DAYS = 30
NO_WARNINGS_TEXT = "No major warnings"

# Documented phishing-indicator thresholds: (name, feature, op, value).
INDICATOR_RULES = [
    ("long_url", "url_length", ">", 75),
    ("long_domain", "domain_length", ">", 30),
    ("has_at", "at_count", ">", 0),
    ("redirect_slashes", "double_slash_count", ">", 1),
    ("many_dashes", "dash_count", ">", 1),
    ("many_dots", "dot_count", ">", 3),
    ("no_https", "has_https", "==", 0),
    ("no_valid_ssl", "has_valid_ssl", "==", 0),
    ("ip_host", "has_ip_address", "==", 1),
    ("many_subdomains", "num_subdomains", ">", 2),
    ("young_domain", "domain_age_days", "in [0, v)", 30),
    ("near_brand", "levenshtein_distance", "<=", 2),
    ("typosquat", "typosquatting_score", "==", 1),
]

# Model defaults.
RANDOM_SEED = 42
VALIDATION_SPLIT = 0.2
CV_FOLDS = 5
FOREST_PARAMS = {
    "numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2,
    "featureSubsetStrategy": "sqrt",
}
BOOSTED_PARAMS = {
    "maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
}
MODEL_TYPES = ["random_forest", "xgboost"]

# Sample-dataset seed pools (legitimate first, then phishing).
SAMPLE_LEGITIMATE_URLS = [
    "https://www.google.com", "https://www.facebook.com",
    "https://www.amazon.com", "https://www.microsoft.com",
    "https://www.apple.com", "https://github.com",
    "https://stackoverflow.com", "https://www.wikipedia.org",
    "https://www.linkedin.com", "https://twitter.com",
    "https://www.youtube.com", "https://www.reddit.com",
    "https://www.netflix.com", "https://www.spotify.com",
    "https://www.adobe.com", "https://www.nytimes.com",
    "https://www.bbc.com", "https://www.cnn.com",
    "https://www.paypal.com", "https://www.dropbox.com",
    "https://medium.com", "https://www.quora.com",
    "https://www.instagram.com", "https://www.pinterest.com",
    "https://www.tumblr.com",
]
SAMPLE_PHISHING_URLS = [
    "http://googIe.com.phishing-site.com/login",
    "http://paypa1-secure.com/verify",
    "http://amaz0n-security.com/update",
    "http://faceb00k-login.com/auth",
    "http://microsoft-verify.com/signin",
    "http://apple-id-confirm.com/verify",
    "http://bankofamerica-secure.com/login",
    "http://chase-verify.com/authenticate",
    "http://wellsfargo-update.com/confirm",
    "http://netflix-billing.com/payment",
    "http://paypal-secure-center.com/login",
    "http://google-security-alert.com/verify",
    "http://amazon-account-verify.com/update",
    "http://facebook-security.com/confirm",
    "http://microsoft-account-verify.com/auth",
]

# --- end of fixed values ------------------------------------------------------
