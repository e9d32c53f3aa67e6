"""Lists that results depend on."""

TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "gbraid", "wbraid", "mc_cid", "mc_eid", "igshid", "ref_src", "ref_url", "yclid", "_ga", "_gl", "cmpid", "ct", "mt", "cid", "ncid", "s_kwcid"]
TRACKING_PREFIXES = ["utm_", "hs_"]
AUTHOR_PATHS = ["author", "authors", "byline", "by-lines", "bylineauthor", "contributor", "contributors", "reporter", "reporters", "writer", "writers", "journalist", "journalists", "profile", "profiles", "staff", "staffer", "member", "members", "user", "users", "columnist", "columnists", "editor", "editors", "correspondent", "correspondents", "blogger", "bloggers", "bios", "bio", "presenter", "presenters", "expert", "experts", "our-team", "team", "people"]
AUTHOR_HOSTS = ["author.", "authors.", "profiles.", "byline.", "staff.", "contributor.", "writers.", "reporters."]
SOCIAL_HOSTS = {
    "twitter": ["twitter.com", "x.com"], "facebook": ["facebook.com", "fb.com"], "instagram": ["instagram.com"], "youtube": ["youtube.com", "youtu.be"], "threads": ["threads.net"],
    "mastodon": ["mastodon.social", "mastodon.online", "mastodon.world", "fosstodon.org", "hachyderm.io", "mas.to", "social.coop", "mastodon.xyz", "mastodon.cloud"],
    "bluesky": ["bsky.app", "bsky.social"], "github": ["github.com"], "tiktok": ["tiktok.com"], "substack": ["substack.com"], "medium": ["medium.com"], "reddit": ["reddit.com"],
}
PLACEHOLDER_DOMAINS = ["example.com", "example.org", "example.net", "yourdomain.com", "domain.com", "email.com", "sentry.io", "wixpress.com", "site.com"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp", ".pdf"]
SHARED_MAILBOXES = ["info", "contact", "editor", "editorial", "newsroom", "news", "press", "tips", "admin", "webmaster", "support", "hello", "desk", "letters", "subscriptions", "subscribers", "advertising", "sales"]
NOT_NAMES = ["twitter", "x", "facebook", "instagram", "linkedin", "youtube", "email", "contact", "about", "about the author", "bio", "biography", "stories", "articles", "archives", "follow", "share", "view all", "see all", "read more", "home", "search", "more", "all stories", "website", "threads", "bluesky", "mastodon", "pharma", "biotech", "medtech", "people", "policy", "patients", "regulation", "business", "technology", "opinion", "analysis", "news", "latest", "topic", "topics", "channels"]
CHALLENGE_TITLES = ["just a moment", "attention required", "checking your browser", "verify you are human", "are you a robot", "ddos protection", "access denied", "security check", "please wait", "loading", "verifying", "one more step", "additional verification", "performing security", "connection is secure"]
CHALLENGE_BODIES = ["cf-chl", "challenge-platform", "enable javascript and cookies to continue", "cf-browser-verification", "cf_chl_opt", "captcha", "recaptcha", "hcaptcha", "turnstile", "challenge-running", "datadome", "perimeterx", "incapsula", "_Incapsula_Resource", "px-captcha"]
PAYWALL_TITLES = ["subscribe to continue", "subscriber-only", "member-only", "premium content", "this article is for subscribers", "sign in to read", "create an account", "join to read", "support quality journalism", "unlimited access", "premium article"]
PAYWALL_BODIES = ["subscribe to continue reading", "this article is available to subscribers", " members-only content", "premium content for subscribers", "sign in to access this article", "create a free account to continue", "register for free to continue reading", "subscribe now to continue", "this content is for subscribers only", "article for subscribers", "paywall", "metered-wall", "registration-wall"]
BIO_SELECTORS = [".author-bio", ".author__bio", ".bio", ".author-description", ".author__description", ".author-about", ".author__about", ".about-the-author", ".author-summary", ".profile-description", ".author-intro", ".author__intro", ".about-author", ".author-blurb", ".contributor-bio", ".byline-bio", ".author .description"]
JOB_SELECTORS = [".author-title", ".author__title", ".job-title", ".jobtitle", ".author-role", ".author__role", ".author-position", ".author__position", ".role", ".position", ".author .role"]
LOCATION_SELECTORS = [".author-location", ".author__location", ".author-city", ".author-locality", ".author-location", ".author .location", ".location"]
BYLINE_SELECTORS = ["a[rel~=author]", "a[rel=author]", ".byline a", ".byline__name a", ".byline-name a", ".author a", ".author__name a", ".author-name a", ".author-name", ".contributor a", ".contributor__name a", ".contributor-name a", "[class*=byline] a", "[class*=author] a"]
AUTHOR_SCOPES = [".author", ".byline", ".profile", ".person", ".staff", ".staff-member", ".contributor", ".reporter", ".writer", "[class*=author]", "[class*=byline]", "[class*=contributor]", "[class*=profile]", "[class*=staff]", "[class*=person]"]
AUTHOR_META = ["author", "byl", "byline", "article:author", "parsely-author", "sailthru.author", "author_name", "dc.creator", "citation_author", "dcterms.creator"]
SHEET_HEADERS = ["url", "urls", "article_url", "article url", "link", "article"]
EXPORT_FIELDS = ["article_url", "status", "name", "profile_url", "job_title", "bio", "email", "linkedin", "twitter", "social_links", "organization", "location"]
HEADERS = {"article_url": "Article URL", "article_urls": "Article URLs", "profile_url": "Profile URL", "social_links": "Social Links", "linkedin": "LinkedIn", "twitter": "Twitter / X", "job_title": "Job Title"}
REFUSED, RETRIED = [401, 403, 451], [408, 425, 429, 500, 502, 503, 504]
AUTHOR_LINK_WORDS = ["author", "byline", "profile", "contributor", "reporter", "journalist", "columnist", "about the author", "about this author", "view author", "visit author"]
BYLINE_META = ["author", "byl", "byline", "parsely-author"]
BIO_STARTERS = ["the", "a", "an", "this", "that", "our", "its"]
CSV_FIELDS = ["status", "name", "email", "linkedin", "twitter", "job_title", "organization", "location", "profile_url", "article_url"]
AUTHOR_FIELDS = ["name", "profile_url", "job_title", "bio", "email", "linkedin", "twitter", "social_links", "organization", "location"]
LATIN_CHARSETS = ["iso-8859-1", "latin-1", "windows-1252"]
ESCAPES = {"&": "&amp;", "'": "&#39;", '"': "&quot;", "<": "&lt;", ">": "&gt;"}

# Patterns that results depend on, as Spark reads them.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: A word's edge of ASCII letters, digits and underscores only; Java's own counts other letters too.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: A spelt-out address, between edges and in any case.
OBFUSCATED = r"([A-Za-z0-9._%+-]+)\s*[\[]?\(?\s*at\s*\)?[\]]?\s*([A-Za-z0-9.-]+)\s*[\[]?\(?\s*dot\s*\)?[\]]?\s*([A-Za-z]{2,})"
#: As the one before, with a space or bracket on both sides of "at" and "dot", so that no run of letters that holds them is one.
APART = r"([A-Za-z0-9._%+-]+)(?=[\s\[(])\s*[\[]?\(?\s*at(?=[\s\])])\s*\)?[\]]?\s*([A-Za-z0-9.-]+)(?=[\s\[(])\s*[\[]?\(?\s*dot(?=[\s\])])\s*\)?[\]]?\s*([A-Za-z]{2,})"
NAME_SHAPE = r"^(?U)[\wÀ-ɏ'.\- ]+$"
TITLE_BYLINE = r"(?i)\bBy\s+([A-Za-z](?U)[\w'’.\- ]{1,70}?)(?:\s*[|\-–—]\s|$)"
ROLE_OF = r"(?U)\bis\s+(?:the\s+)?[A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,3}'s\s+([^.,;]{3,60})"
ROLE = r"(?iU)\bis\s+(?:a|an)\s+([^.,;]{3,60}?)(?:\s+(?:for|at|with|of|covering|focused\s+on|focusing\s+on|who)\b|[,.;]|$)"
NAMED_OPENING = r"^(?U)[A-Z][\w'À-ɏ.\-]+(\s+[A-Z][\w'À-ɏ.\-]+){0,3}\s+"
