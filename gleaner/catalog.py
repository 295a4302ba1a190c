"""Dimensions of the audit: checks, categories, weights, bots and phrases."""

from __future__ import annotations

# Names, categories and default severities that results carry.
CHECKS = {
    "ai_infrastructure": (
        ("robots.txt", "error"), ("sitemap.xml", "error"), ("llms.txt", "warning"), ("llms-full.txt", "warning"),
        ("AI Policy (ai.txt / ai.json)", "warning"), ("AI Bot Blocking", "error"), ("AI Content Directives", "notice"),
        ("Training vs Retrieval Bot Strategy", "notice"), ("agent-card.json", "notice"), ("agents.json", "notice"),
    ),
    "content_quality": (
        ("Structured Data (JSON-LD)", "warning"), ("FAQ Content", "notice"), ("Content Structure & Depth", "warning"),
        ("Heading Hierarchy", "warning"), ("Meta Descriptions", "warning"), ("Content Freshness", "notice"),
        ("Schema Markup Diversity", "notice"), ("Featured Snippet Readiness", "notice"), ("Answer Format Diversity", "notice"),
        ("Voice Search Optimization", "notice"), ("Duplicate Titles", "warning"), ("Duplicate Meta Descriptions", "warning"),
        ("Content Too Long for AI", "notice"), ("Paragraph Length Optimization", "notice"), ("Answer-First Content Structure", "notice"),
        ("Organization Schema Completeness", "warning"), ("Security Headers", "notice"), ("Compression", "warning"),
        ("Content Quotability Score", "notice"), ("Topic Cluster Detection", "notice"), ("Content Readability", "notice"),
    ),
    "ai_discoverability": (
        ("Server-side Rendering", "error"), ("Search Engine Indexing", "error"), ("Open Graph Tags", "notice"),
        ("Author & Expertise Signals", "notice"), ("Trust Signals", "notice"), ("Social Proof & Authority", "notice"),
        ("Citation Quality", "notice"), ("Twitter Card Tags", "notice"), ("Breadcrumb Schema", "notice"), ("hreflang Tags", "notice"),
        ("Brand Authority Score", "notice"),
    ),
    "foundational_seo": (
        ("Title Tags", "warning"), ("Image Alt Text", "warning"), ("Internal Linking", "warning"), ("Mobile Viewport", "error"),
        ("HTTPS Enforcement", "error"), ("Broken Pages", "error"), ("Nofollow on Internal Links", "warning"),
        ("URL Structure Quality", "warning"), ("Canonical Link Issues", "error"), ("Semantic HTML Usage", "notice"),
        ("Text-to-HTML Ratio", "warning"), ("Page Response Time", "warning"), ("Redirect Chains", "warning"),
        ("Character Encoding & Doctype", "error"), ("HTML Page Size", "warning"), ("Crawl Depth", "notice"),
        ("Broken External Links", "warning"), ("Temporary Redirects", "warning"), ("Missing H1 Heading", "warning"),
        ("Core Web Vitals", "warning"), ("Mobile Readiness", "warning"), ("Responsive Images", "notice"),
    ),
    "non_scored": (("security.txt", "info"), ("tdmrep.json", "info"), ("manifest.json", "info"), ("humans.txt", "info")),
}
SEVERITY = {name: severity for checks in CHECKS.values() for name, severity in checks}
CATEGORY = {name: category for category, checks in CHECKS.items() for name, _ in checks}

# Weights of categories and of the items of two composite scores.
CATEGORY_WEIGHTS = {"ai_infrastructure": 1.5, "content_quality": 3.0, "ai_discoverability": 2.5, "foundational_seo": 2.5, "non_scored": 0.0}
SEARCH_HEALTH = {
    "AI Bot Blocking": 2.0, "robots.txt": 2.0, "llms.txt": 2.0, "llms-full.txt": 1.0, "AI Policy (ai.txt / ai.json)": 1.0,
    "AI Content Directives": 1.0, "Training vs Retrieval Bot Strategy": 1.0, "agent-card.json": 0.5, "agents.json": 0.5,
}
SERVICE_SCORE = {
    "robots.txt": 2.0, "AI Bot Blocking": 2.0, "sitemap.xml": 2.0, "llms.txt": 2.0, "Search Engine Indexing": 2.0, "llms-full.txt": 1.5,
    "AI Policy (ai.txt / ai.json)": 1.5, "Training vs Retrieval Bot Strategy": 1.5, "Structured Data (JSON-LD)": 1.5,
    "AI Content Directives": 1.0, "security.txt": 0.5, "tdmrep.json": 0.5, "agent-card.json": 0.5, "agents.json": 0.5,
}
# Items the engine can make by itself, and the scores they then have.
PROJECTED = {
    "robots.txt": 100, "AI Bot Blocking": 100, "sitemap.xml": 100, "llms.txt": 100, "llms-full.txt": 100,
    "AI Policy (ai.txt / ai.json)": 100, "security.txt": 100, "tdmrep.json": 100, "humans.txt": 100, "manifest.json": 100,
    "Structured Data (JSON-LD)": 85,
}

# Crawlers that robots.txt rules are checked for.
AI_CRAWLERS = (
    "GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "Claude-SearchBot", "Google-Extended", "Applebot-Extended",
    "Meta-ExternalAgent", "PerplexityBot", "Amazonbot", "CCBot", "DuckAssistBot", "Bytespider",
)
MAJOR_CRAWLERS = ("GPTBot", "ClaudeBot", "Google-Extended", "PerplexityBot", "Applebot-Extended")
TRAINING_BOTS = ("CCBot", "GPTBot", "Google-Extended", "Bytespider")
RETRIEVAL_BOTS = ("OAI-SearchBot", "ChatGPT-User", "Claude-SearchBot", "PerplexityBot")

# Phrases that are counted in texts.
TRANSITIONS = (
    "furthermore", "additionally", "moreover", "in addition", "it's worth noting", "it is worth noting", "it's important to note",
    "it is important to note", "it should be noted", "in conclusion", "to summarize", "in summary", "as mentioned earlier",
    "as previously mentioned", "that being said", "with that in mind", "having said that", "on the other hand", "by the same token",
    "needless to say", "it goes without saying", "at the end of the day", "when all is said and done", "in the realm of", "in the world of",
    "plays a crucial role", "plays a vital role", "plays an important role", "stands as a testament", "serves as a reminder",
)
OPENERS = (
    "in today's", "when it comes to", "it is important to", "it's important to", "whether you're", "if you're looking", "one of the most",
    "there are many", "there are several", "in this article", "in this guide", "in this post", "let's dive", "let's explore",
    "let's take a look", "here are some", "here's what you need", "here's everything", "are you looking for", "have you ever wondered",
    "the importance of", "the benefits of", "the advantages of", "this comprehensive", "this ultimate", "this definitive",
)
HEDGES = (
    "generally speaking", "in many cases", "in most cases", "it depends on", "can vary depending", "may vary", "typically", "essentially",
    "basically", "arguably", "it's no secret that", "it comes as no surprise", "not surprisingly", "unsurprisingly", "a wide range of",
    "a variety of", "numerous", "various aspects", "key considerations", "robust", "leverage", "utilize", "facilitate", "cutting-edge",
    "state-of-the-art", "best-in-class", "seamless", "seamlessly", "holistic", "synergy",
)
PERSONAL = (r"i ('|a)m", "my", r"we ('|a)re", "our", "i think", "i believe", "in my experience", "i've", "we've", "i found")

# Site sections by path, the first that fits.
SECTIONS = (
    ("Main", r"^/(index(\.html)?)?$"),
    ("Documentation", r"^/(docs?|documentation|guide|manual|reference|api)"),
    ("Blog", r"^/(blog|news|articles?|posts?)"),
    ("About", r"^/(about|team|company|who-we-are)"),
    ("Products", r"^/(products?|shop|store|pricing|plans)"),
    ("Services", r"^/(services?|solutions?)"),
    ("Support", r"^/(contact|support|help|faq)"),
    ("Legal", r"^/(legal|privacy|terms|tos|cookie)"),
    ("Careers", r"^/(careers?|jobs?)"),
    ("Examples", r"^/(examples?|demos?|showcase|gallery|portfolio)"),
    ("Changelog", r"^/(changelog|releases?|whats-new)"),
)
# Change frequency and priority of sitemap entries by path, the first that fits.
SITEMAP = (
    (r"^/(index\.html)?$", "daily", "1.0"),
    (r"^/(blog|news|articles?)", "weekly", "0.7"),
    (r"^/(docs?|documentation|api|reference)", "weekly", "0.8"),
    (r"^/(about|contact|pricing|products?)", "monthly", "0.6"),
    (r"^/(legal|privacy|terms)", "yearly", "0.3"),
    ("", "monthly", "0.5"),
)
# Tags that count as semantic markup.
SEMANTIC_TAGS = ("<article", "<section", "<main", "<figure", "<aside", "<nav", "<header", "<footer")

# Word patterns of citable passages, all between word boundaries and without regard to case.
DEPENDENT = (
    "however|but|also|additionally|furthermore|moreover|nevertheless|consequently|therefore|thus|hence|meanwhile|still|yet|besides|likewise|similarly|in addition|as a result|on the other hand|in contrast|for this reason"
)
DEFINITIVE = (
    r"(?:is|are|was|were)\s+(?:a|an|the|one of)",
    r"(?:provides?|offers?|delivers?|enables?|ensures?)",
    r"(?:refers? to|means?|defined? as|known as)",
    r"(?:according to|research shows?|studies? (?:show|indicate|suggest))",
)
UNIQUE = (
    r"(?:our|we)\s+(?:research|data|findings|analysis|study|survey|team|experience)",
    r"(?:we\s+(?:found|discovered|tested|measured|observed|implemented|built|developed))",
    r"(?:proprietary|exclusive|original|first-party|in-house)",
    r"case\s+stud(?:y|ies)",
    r"client\s+results?",
    r"(?:I've|we've|I\s+have|we\s+have)\s+(?:been|worked|spent|tested)",
)
# Words of the patterns above, in their order: each match holds one of its pattern's words, without regard to case.
DEFINITIVE_HOLD = (
    ("is", "are", "was", "were"), ("provide", "offer", "deliver", "enable", "ensure"), ("refer", "mean", "define", "known"),
    ("according", "research", "studie"),
)
UNIQUE_HOLD = (
    ("research", "data", "findings", "analysis", "study", "survey", "team", "experience"),
    ("found", "discovered", "tested", "measured", "observed", "implemented", "built", "developed"),
    ("proprietary", "exclusive", "original", "first-party", "in-house"), ("case",), ("client",), ("been", "worked", "spent", "tested"),
)
# Figures in citable passages, with no boundaries but those written.
FIGURES = (
    r"\d+(?:\.\d+)?%", r"\$[\d,]+(?:\.\d{2})?", r"€[\d,]+(?:\.\d{2})?", r"\b\d{4}\b", r"\b\d+(?:\.\d+)?x\b", r"\b\d+(?:,\d{3})+\b",
    r"\b(?:increased|decreased|grew|dropped|rose|fell)\s+(?:by\s+)?\d",
)
COMPARED = r"\b(?:more|less|higher|lower|faster|slower|better|worse|compared|versus|vs)\b.*\d"
# Weights of the five dimensions, in hundredths.
CITABILITY = {"answer": 30, "self_contained": 25, "structure": 20, "figures": 15, "unique": 10}

# Effort, weight in search and time until it shows, of items to work on.
EFFORT = {
    "Open Graph Tags": "easy", "AI Content Directives": "easy", "Mobile Viewport": "easy", "Twitter Card Tags": "easy",
    "Meta Descriptions": "medium", "Image Alt Text": "medium", "Title Tags": "medium", "Content Freshness": "medium",
    "Internal Linking": "medium", "Broken Pages": "medium", "Duplicate Titles": "medium", "Duplicate Meta Descriptions": "medium",
    "URL Structure Quality": "medium", "Canonical Link Issues": "medium", "Nofollow on Internal Links": "easy",
    "Server-side Rendering": "hard", "Heading Hierarchy": "hard", "Content Structure & Depth": "hard", "Search Engine Indexing": "hard",
    "FAQ Content": "hard", "HTTPS Enforcement": "hard", "Author & Expertise Signals": "hard", "Trust Signals": "hard",
    "Social Proof & Authority": "hard", "Citation Quality": "hard", "Featured Snippet Readiness": "hard",
    "Voice Search Optimization": "hard", "Answer Format Diversity": "hard", "Schema Markup Diversity": "hard",
    "Content Too Long for AI": "medium", "Paragraph Length Optimization": "hard", "Answer-First Content Structure": "hard",
    "Organization Schema Completeness": "medium", "Breadcrumb Schema": "medium", "Semantic HTML Usage": "hard",
    "Training vs Retrieval Bot Strategy": "easy", "Text-to-HTML Ratio": "hard", "Page Response Time": "hard", "Redirect Chains": "medium",
    "Character Encoding & Doctype": "easy", "HTML Page Size": "hard", "Crawl Depth": "hard", "Security Headers": "medium",
    "Compression": "easy", "hreflang Tags": "medium", "agent-card.json": "medium", "agents.json": "medium",
    "Content Quotability Score": "hard", "Topic Cluster Detection": "hard", "Broken External Links": "medium",
    "Temporary Redirects": "easy", "Missing H1 Heading": "easy", "Content Readability": "hard", "Core Web Vitals": "hard",
    "Brand Authority Score": "hard", "Mobile Readiness": "medium", "Responsive Images": "medium",
}
SEARCH_IMPACT = {
    "Search Engine Indexing": "foundational", "HTTPS Enforcement": "foundational", "Broken Pages": "foundational",
    "Server-side Rendering": "foundational", "Canonical Link Issues": "foundational", "Title Tags": "high", "Meta Descriptions": "high",
    "Content Structure & Depth": "high", "Heading Hierarchy": "high", "Internal Linking": "high", "Duplicate Titles": "high",
    "Duplicate Meta Descriptions": "high", "Image Alt Text": "medium", "FAQ Content": "medium", "Mobile Viewport": "medium",
    "Open Graph Tags": "medium", "AI Content Directives": "medium", "Content Freshness": "medium", "URL Structure Quality": "medium",
    "Nofollow on Internal Links": "medium", "Semantic HTML Usage": "medium", "Organization Schema Completeness": "medium",
    "Author & Expertise Signals": "low", "Trust Signals": "low", "Social Proof & Authority": "low", "Citation Quality": "low",
    "Featured Snippet Readiness": "low", "Voice Search Optimization": "low", "Answer Format Diversity": "low",
    "Schema Markup Diversity": "low", "Content Too Long for AI": "low", "Paragraph Length Optimization": "low",
    "Answer-First Content Structure": "low", "Breadcrumb Schema": "low", "Twitter Card Tags": "low",
    "Training vs Retrieval Bot Strategy": "low", "Text-to-HTML Ratio": "medium", "Page Response Time": "high", "Redirect Chains": "medium",
    "Character Encoding & Doctype": "foundational", "HTML Page Size": "medium", "Crawl Depth": "medium", "Security Headers": "low",
    "Compression": "medium", "hreflang Tags": "low", "agent-card.json": "low", "agents.json": "low", "Content Quotability Score": "medium",
    "Topic Cluster Detection": "medium", "Broken External Links": "medium", "Temporary Redirects": "medium", "Missing H1 Heading": "high",
    "Content Readability": "low", "Core Web Vitals": "high", "Brand Authority Score": "high", "Mobile Readiness": "high",
    "Responsive Images": "medium",
}
TIME_TO_IMPACT = {
    "Open Graph Tags": "immediate", "AI Content Directives": "immediate", "Mobile Viewport": "immediate",
    "Nofollow on Internal Links": "immediate", "Training vs Retrieval Bot Strategy": "immediate", "Twitter Card Tags": "immediate",
    "Meta Descriptions": "2-4 weeks", "Image Alt Text": "2-4 weeks", "Title Tags": "2-4 weeks", "Broken Pages": "2-4 weeks",
    "Internal Linking": "2-4 weeks", "Content Freshness": "2-4 weeks", "Heading Hierarchy": "2-4 weeks", "Duplicate Titles": "2-4 weeks",
    "Duplicate Meta Descriptions": "2-4 weeks", "URL Structure Quality": "2-4 weeks", "Canonical Link Issues": "2-4 weeks",
    "Organization Schema Completeness": "2-4 weeks", "Breadcrumb Schema": "2-4 weeks", "Server-side Rendering": "2-6 months",
    "Content Structure & Depth": "2-6 months", "Search Engine Indexing": "2-6 months", "FAQ Content": "2-6 months",
    "HTTPS Enforcement": "2-6 months", "Author & Expertise Signals": "2-6 months", "Trust Signals": "2-6 months",
    "Social Proof & Authority": "2-6 months", "Citation Quality": "2-6 months", "Featured Snippet Readiness": "2-6 months",
    "Voice Search Optimization": "2-6 months", "Answer Format Diversity": "2-6 months", "Schema Markup Diversity": "2-6 months",
    "Content Too Long for AI": "2-4 weeks", "Paragraph Length Optimization": "2-6 months", "Answer-First Content Structure": "2-6 months",
    "Semantic HTML Usage": "2-6 months", "Text-to-HTML Ratio": "2-6 months", "Page Response Time": "2-4 weeks",
    "Redirect Chains": "2-4 weeks", "Character Encoding & Doctype": "immediate", "HTML Page Size": "2-6 months",
    "Crawl Depth": "2-6 months", "Security Headers": "immediate", "Compression": "immediate", "hreflang Tags": "2-4 weeks",
    "agent-card.json": "2-4 weeks", "agents.json": "2-4 weeks", "Content Quotability Score": "2-6 months",
    "Topic Cluster Detection": "2-6 months", "Broken External Links": "2-4 weeks", "Temporary Redirects": "immediate",
    "Missing H1 Heading": "2-4 weeks", "Content Readability": "2-6 months", "Core Web Vitals": "2-6 months",
    "Brand Authority Score": "2-6 months", "Mobile Readiness": "2-4 weeks", "Responsive Images": "2-4 weeks",
}

# Figures and sources in page texts, in this order.
STATISTICS = (r"\d+(?:\.\d+)?%", r"(?i)\d+x\b", r"(?i)\$\d+(?:\.\d+)?\s*(?:million|billion|trillion|M|B|K)", r"(?i)\d+\s+out\s+of\s+\d+")
SOURCES = (
    r"(?i)according\s+to\s+([^,.;]+)",
    r"(?i)(?:study|research|report|survey)\s+(?:by|from)\s+([^,.;]+)",
    r"(?i)(?:study|research)\s+(?:shows?|finds?|found|reveals?)",
)
# Platforms by address, the first that fits.
SOCIAL = (
    ("twitter", r"(?i)twitter\.com|x\.com"), ("facebook", r"(?i)facebook\.com"), ("linkedin", r"(?i)linkedin\.com"),
    ("instagram", r"(?i)instagram\.com"), ("youtube", r"(?i)youtube\.com"), ("github", r"(?i)github\.com"), ("tiktok", r"(?i)tiktok\.com"),
    ("pinterest", r"(?i)pinterest\.com"), ("mastodon", r"(?i)mastodon\.|mstdn\."), ("bluesky", r"(?i)bsky\.app"),
    ("threads", r"(?i)threads\.net"),
)
MAJOR_PLATFORMS = ("facebook", "twitter", "x", "linkedin", "instagram", "youtube", "github", "tiktok")
# Software by texts in the page, attributes, and linked files.
TECH = (
    ("Next.js", ("__next", "_next/static"), (), ()), ("Nuxt.js", ("__nuxt",), (), ()), ("Gatsby", ("__gatsby",), (), ()),
    ("React", (), ("data-reactroot", "data-reactid"), ()), ("Angular", (), ("ng-app", "ng-controller", "data-ng-app"), ()),
    ("Vue.js", ("__vue",), ("data-v-",), ()), ("Svelte", (), ("data-svelte",), ()), ("WordPress", ("wp-content", "wp-includes"), (), ()),
    ("Shopify", ("Shopify.theme",), (), ()), ("Squarespace", ("squarespace",), (), ()), ("Wix", ("wixsite.com", "wix-code"), (), ()),
    ("Bootstrap", (), (), ("bootstrap",)), ("Tailwind CSS", ("tailwindcss",), (), ("tailwind",)),
)
# Schema types that count for diversity.
VALUABLE_TYPES = (
    "FAQPage", "HowTo", "Article", "BlogPosting", "Product", "BreadcrumbList", "Organization", "WebSite", "LocalBusiness", "Review",
)
# Word patterns of several checks, all between word boundaries and without regard to case.
DEFINES = "is a|is an|refers to|is defined as|means"
ASKS_FIRST = "how|what|why|when|where|who|which|can|does|is|are|should"
LEADS_BY_QUESTION = "how|what|why|when|where|who|which"
ANSWERS = "is|are|provides|offers|helps|enables|allows|includes|means|refers"
QUOTABLE = "is|are|was|were|has|have|provides|offers|includes|enables|allows|contains|features|supports|delivers|ensures"
LEANS_ON_CONTEXT = "however|but|also|additionally|furthermore|moreover|nevertheless|consequently|therefore"
# Signals of expertise, by dimension: patterns of texts, paths and headings, and points.
FIRST_PERSON = r"our experience|we've worked|I've been|we implemented|we tested|we found|in my experience|from our work"
RESEARCH = r"our research|we surveyed|our findings|our data shows?|we measured|we analyzed|our analysis"
CREDENTIALS = r"certified|licensed|accredited|PhD|Ph\.D|master'?s|degree|years? of experience|[0-9]+\+?\s*years?"
AWARDS = r"award|recognized|featured in|as seen in|winner|nominated|top [0-9]+|best (?:of|in)"
# Well-known files, and the fields of an agent card with their points.
FILES = (
    "robots.txt", "sitemap.xml", "llms.txt", "llms-full.txt", "ai.txt", "ai.json", "security.txt", "tdmrep.json", "humans.txt",
    "manifest.json", "BingSiteAuth.xml", "agent-card.json", "agents.json",
)
AGENT_CARD = (("name", 20), ("description", 20), ("url", 15), ("capabilities", 15))
# Answer engines; each of their terms is the mean of some scores, times a weight.
PLATFORMS = {
    "google_ai_overviews": (
        (("Title Tags", "Meta Descriptions", "Internal Linking"), 0.30), (("questions",), 0.20), (("structure",), 0.20),
        (("Structured Data (JSON-LD)",), 0.15), (("Featured Snippet Readiness",), 0.15),
    ),
    "chatgpt": (
        (("indexed and Bing 20",), 0.25), (("Organization Schema Completeness", "Structured Data (JSON-LD)"), 0.25),
        (("Content Quotability Score",), 0.20), (("Author & Expertise Signals", "Trust Signals"), 0.15),
        (("Social Proof & Authority",), 0.15),
    ),
    "perplexity": (
        (("linked reddit",), 0.30), (("Content Freshness",), 0.25), (("Citation Quality",), 0.20), (("Content Structure & Depth",), 0.15),
        (("FAQ Content",), 0.10),
    ),
    "gemini": (
        (("indexed and Google 15",), 0.25), (("Organization Schema Completeness",), 0.20), (("linked youtube",), 0.20),
        (("reachable",), 0.15), (("Heading Hierarchy", "Content Structure & Depth"), 0.20),
    ),
    "bing_copilot": (
        (("indexed and Bing 25",), 0.30), (("Organization Schema Completeness", "Structured Data (JSON-LD)"), 0.20),
        (("linked linkedin",), 0.20), (("Meta Descriptions", "Heading Hierarchy"), 0.15),
        (("Author & Expertise Signals", "Trust Signals"), 0.15),
    ),
}
# Weights of platforms in a brand's score, in hundredths.
BRAND_WEIGHTS = (("youtube", 35), ("reddit", 25), ("wikipedia", 25), ("linkedin", 15))
# Last labels of domains that name no country.
GENERIC_DOMAINS = ("com", "org", "net", "io", "dev", "app", "co", "info", "biz", "xyz", "ai", "me")
# Order of sections in llms.txt; those after the seventh are optional.
LLMS_SECTIONS = (
    "Main", "Documentation", "Products", "Services", "Blog", "About", "Support", "Legal", "Careers", "Changelog", "Examples", "Pages",
)
# What crawlers are for.
CRAWLER_USE = (
    ("GPTBot", "training"), ("OAI-SearchBot", "search"), ("ChatGPT-User", "search"), ("ClaudeBot", "training"),
    ("Claude-SearchBot", "search"), ("Google-Extended", "training"), ("Applebot-Extended", "training"), ("Meta-ExternalAgent", "training"),
    ("PerplexityBot", "search"), ("Amazonbot", "training"), ("CCBot", "training"), ("DuckAssistBot", "training"),
    ("Bytespider", "training"),
)
# Items that are quick or strategic to work on.
QUICK = (
    "robots.txt", "sitemap.xml", "llms.txt", "llms-full.txt", "AI Policy (ai.txt / ai.json)", "Meta Descriptions", "Title Tags",
    "Missing H1 Heading", "AI Content Directives", "Open Graph Tags", "Twitter Card Tags", "agent-card.json", "agents.json",
)
STRATEGIC = (
    "Content Structure & Depth", "Content Freshness", "Topic Cluster Detection", "Content Readability", "Answer-First Content Structure",
    "Voice Search Optimization", "Brand Authority Score", "Social Proof & Authority",
)
# Files and settings that a gap analysis looks at.
GAP_FILES = (
    "robots.txt", "sitemap.xml", "llms.txt", "llms-full.txt", "AI Policy (ai.txt / ai.json)", "security.txt", "tdmrep.json",
    "manifest.json", "agent-card.json", "agents.json",
)
GAP_SETTINGS = ("robots.txt", "AI Content Directives", "Training vs Retrieval Bot Strategy")
# Elements that hold a page's content, the first that holds enough.
CONTENT = (
    "main", "article", '[role="main"]', ".content", "#content", ".post-content", ".entry-content", ".article-content", ".page-content",
)
# Countries by the last label of a domain, and codes of languages that name one country.
COUNTRIES = {
    "lt": "Lithuania", "lv": "Latvia", "ee": "Estonia", "pl": "Poland", "de": "Germany", "fr": "France", "es": "Spain", "it": "Italy",
    "nl": "Netherlands", "be": "Belgium", "at": "Austria", "ch": "Switzerland", "cz": "Czech Republic", "sk": "Slovakia", "hu": "Hungary",
    "ro": "Romania", "bg": "Bulgaria", "hr": "Croatia", "si": "Slovenia", "fi": "Finland", "se": "Sweden", "dk": "Denmark", "no": "Norway",
    "pt": "Portugal", "ie": "Ireland", "uk": "United Kingdom", "ua": "Ukraine", "ru": "Russia", "by": "Belarus", "us": "United States",
    "ca": "Canada", "au": "Australia", "nz": "New Zealand", "jp": "Japan", "kr": "South Korea", "cn": "China", "in": "India",
    "br": "Brazil", "mx": "Mexico", "ar": "Argentina", "cl": "Chile", "co": "Colombia",
}
TELLING_LANGUAGES = ("lt", "lv", "et", "fi", "hu", "cz", "sk", "hr", "si", "bg", "ro", "ua", "by", "jp", "kr")
GENERIC_TYPES = ("WebSite", "WebPage", "Organization", "BreadcrumbList")
# Places in the locative, by what names them, the first that fits.
LOCATIVE = (
    ("(?iu)lithuania", "Lietuvoje"), ("(?iu)vilnius", "Vilniuje"), ("(?iu)kaunas", "Kaune"), ("(?iu)klaipeda|klaipėda", "Klaipėdoje"),
    ("(?iu)šiauliai|siauliai", "Šiauliuose"), ("(?iu)panevėžys|panevezys", "Panevėžyje"),
)
# Query templates by language of the site: query, category, intent, language. {in} and {at} stand for a place with " in " or a
# blank before it, {where} for one in the locative; a template whose keyword is missing is left out.
QUERY_TEMPLATES = {
    "en": (
        ("what does {name} do and are they reputable", "brand", "Brand reputation query", "en"),
        ("{name} {industry} reviews and pricing", "brand", "Brand evaluation search", "en"),
        ("how to choose a good {service0} provider{in}", "generic_faq", "Industry FAQ: choosing provider", "en"),
        ("what should I look for when buying {service1}", "generic_faq", "Industry FAQ: buying guide", "en"),
        ("what is the difference between cheap and premium {industry}", "generic_faq", "Industry FAQ: quality comparison", "en"),
        ("how much does {service0} typically cost{in}", "generic_faq", "Industry FAQ: pricing", "en"),
        ("what are the benefits of professional {service0}", "generic_faq", "Industry FAQ: benefits", "en"),
        ("common mistakes when choosing {industry} services", "generic_faq", "Industry FAQ: mistakes to avoid", "en"),
        ("{industry} trends and innovations this year", "generic_faq", "Industry FAQ: trends", "en"),
        ("how long does {service0} process usually take", "generic_faq", "Industry FAQ: timeline", "en"),
        ("best {industry} companies{in} comparison", "purchase_intent", "Purchase comparison query", "en"),
        ("top rated {service0} providers near me", "purchase_intent", "Purchase: local search", "en"),
        ("{service0} price comparison{at}", "purchase_intent", "Purchase: price comparison", "en"),
        ("recommend a reliable {industry} company for {service1}", "purchase_intent", "Purchase: recommendation", "en"),
        ("where to order custom {service0}{in}", "purchase_intent", "Purchase: where to buy", "en"),
        ("{service0} vs {service1} which is better for my needs", "purchase_intent", "Purchase: service comparison", "en"),
        (
            "explain the pros and cons of different {industry} approaches for someone just getting started", "page_specific",
            "Educational content query", "en",
        ),
        ("step by step guide to {service0}", "page_specific", "How-to content query", "en"),
        ("{keyword0} complete guide and tips", "page_specific", "Keyword content query", "en"),
        ("everything you need to know about {keyword1}", "page_specific", "Keyword content query", "en"),
    ),
    "lt": (
        ("kas yra {name} ir ar jie patikimi", "brand", "Brand reputation query (LT)", "lt"),
        ("{name} atsiliepimai ir kainos", "brand", "Brand evaluation search (LT)", "lt"),
        ("kaip pasirinkti gerą {service0} paslaugų teikėją {where}", "generic_faq", "Industry FAQ: choosing provider (LT)", "lt"),
        ("į ką atkreipti dėmesį renkantis {service1}", "generic_faq", "Industry FAQ: buying guide (LT)", "lt"),
        ("kiek kainuoja {service0} {where}", "generic_faq", "Industry FAQ: pricing (LT)", "lt"),
        ("{industry} tendencijos ir naujienos Lietuvoje", "generic_faq", "Industry FAQ: trends (LT)", "lt"),
        ("dažniausios klaidos renkantis {industry} paslaugas", "generic_faq", "Industry FAQ: mistakes (LT)", "lt"),
        ("kokia nauda naudotis profesionaliu {service0}", "generic_faq", "Industry FAQ: benefits (LT)", "lt"),
        ("best {industry} services in Lithuania", "generic_faq", "Industry FAQ: English for AI engines", "en"),
        ("how does {industry} work in Lithuania", "generic_faq", "Industry FAQ: English context", "en"),
        ("geriausios {industry} įmonės {where} palyginimas", "purchase_intent", "Purchase comparison (LT)", "lt"),
        ("rekomenduokite patikimą {service0} teikėją {where}", "purchase_intent", "Purchase: recommendation (LT)", "lt"),
        ("{service0} kainų palyginimas {where}", "purchase_intent", "Purchase: price comparison (LT)", "lt"),
        ("kur užsisakyti {service0} {where}", "purchase_intent", "Purchase: where to buy (LT)", "lt"),
        ("top {industry} companies in Lithuania comparison", "purchase_intent", "Purchase comparison (EN)", "en"),
        ("{service0} vs {service1} which is better", "purchase_intent", "Purchase: service comparison (EN)", "en"),
        ("{keyword0} pilnas vadovas ir patarimai", "page_specific", "Keyword content query (LT)", "lt"),
        ("viskas ką reikia žinoti apie {keyword1}", "page_specific", "Keyword content query (LT)", "lt"),
        ("{industry} {where} išsamus aprašymas pradedantiesiems", "page_specific", "Educational content (LT)", "lt"),
        ("{service0} žingsnis po žingsnio vadovas", "page_specific", "How-to content (LT)", "lt"),
    ),
}
QUERY_CATEGORIES = ("brand", "generic_faq", "purchase_intent", "page_specific")
# Advice for a passage, by dimension and the score below which it is given.
ADVICE = (
    ("answer", 50, "Start with a direct, definitive statement that answers a question"),
    ("self_contained", 50, 'Make this passage self-contained — avoid starting with "however", "but", or pronouns referring to prior text'),
    ("structure", 50, "Add structure — use a list, table, or keep to 100-200 words"),
    ("figures", 30, "Add specific data: percentages, costs, timeframes, or comparisons"),
    ("unique", 30, "Include first-party data, case study results, or original research"),
)
# Phrases and addresses that tell what a site is for.
SHOP_PHRASES = ("add to cart", "buy now", "shopping cart", "checkout", "price", "product")
SOFTWARE_PHRASES = ("sign up", "free trial", "pricing", "demo", "api", "dashboard", "login")
PUBLISHED_AT = "/(blog|news|article|post)"
# Addresses and headings that tell what a page is.
ARTICLE_PATH, BLOG_PATH, PRODUCT_PATH = r"^/(blog|news|articles?|posts?)/[^/]+", r"^/(blog|posts?)/", r"^/(products?|shop|store)/[^/]+"
STEP_HEADING = r"(?i)^(?:step\s+[0-9]+|[0-9]+[.)]\s)"
# Addresses that a crawl leaves out.
BINARY = r"(?i)\.(pdf|zip|png|jpg|jpeg|gif|svg|css|js|ico|woff|woff2|ttf|eot|mp4|mp3|avi|mov)$"
# Files of the components of a gap analysis that have several, or lie elsewhere.
GAP_PATHS = {
    "AI Policy (ai.txt / ai.json)": ("ai.txt", "ai.json"), "security.txt": (".well-known/security.txt",),
    "tdmrep.json": (".well-known/tdmrep.json",), "agent-card.json": (".well-known/agent-card.json",),
}
# Whose crawlers they are, and what for.
CRAWLER_OWNERS = {
    "GPTBot": ("OpenAI", "Model training"), "OAI-SearchBot": ("OpenAI", "Search results"), "ChatGPT-User": ("OpenAI", "Live browsing"),
    "ClaudeBot": ("Anthropic", "Model training & citations"), "Claude-SearchBot": ("Anthropic", "Search"),
    "Google-Extended": ("Google", "Gemini training"), "Applebot-Extended": ("Apple", "Apple Intelligence"),
    "Meta-ExternalAgent": ("Meta", "AI training"), "PerplexityBot": ("Perplexity", "Answer engine"), "Amazonbot": ("Amazon", "Alexa / AI"),
    "CCBot": ("Common Crawl", "Open dataset"), "DuckAssistBot": ("DuckDuckGo", "DuckDuckGo AI"), "Bytespider": ("ByteDance", "AI training"),
}
TRAINING_LISTED = ("GPTBot", "ClaudeBot", "Google-Extended", "Applebot-Extended", "Meta-ExternalAgent", "CCBot", "Bytespider", "Amazonbot")
SEARCH_LISTED = ("OAI-SearchBot", "ChatGPT-User", "Claude-SearchBot", "PerplexityBot", "DuckAssistBot")
