"""Word lists and patterns of query understanding.

These are fixed values: results depend on them entry by entry.
"""

# --- fixed values -----------------------------------------------------------

CONTRACTIONS = {
    "don't": "do not", "won't": "will not", "can't": "cannot", "it's": "it is", "i'm": "i am", "we're": "we are",
    "they're": "they are", "you're": "you are", "hasn't": "has not", "haven't": "have not", "isn't": "is not",
    "aren't": "are not", "wasn't": "was not", "weren't": "were not", "let's": "let us", "that's": "that is",
    "who's": "who is", "what's": "what is", "where's": "where is", "when's": "when is", "why's": "why is",
    "how's": "how is", "i've": "i have", "we've": "we have", "they've": "they have", "you've": "you have",
    "should've": "should have", "would've": "would have", "could've": "could have",
}

STOP_WORDS = (
    "the a an and or but in on at to for of with is are was were been be have has had do does did will would should"
    " could may might must can this that these those it its he she him her his they them their"
).split()

FILE_TYPES = [
    (r"\b(pdf|pdfs)\b", "pdf"), (r"\b(doc|docx|word|document|documents)\b", "docx"),
    (r"\b(txt|text|text file|textfile)\b", "txt"), (r"\b(md|markdown)\b", "md"), (r"\b(json)\b", "json"),
    (r"\b(xml)\b", "xml"), (r"\b(csv)\b", "csv"), (r"\b(code|source)\b", "code"),
]

RELATIVE_DATES = [
    ("today", 0), ("yesterday", 1), ("last week", 7), ("this week", 0), ("last month", 30), ("this month", 0),
    ("last year", 365), ("this year", 0),
]

LANGUAGES = (
    "kotlin java python javascript typescript c++ cpp rust go golang swift ruby php scala r matlab c# csharp dart perl"
    " haskell lua sql html css"
).split()

DOMAINS = {
    "ml": "machine learning", "ai": "artificial intelligence", "dl": "deep learning",
    "nlp": "natural language processing", "cv": "computer vision", "api": "application programming interface",
    "rest": "rest api", "graphql": "graphql", "db": "database", "nosql": "nosql database", "ui": "user interface",
    "ux": "user experience", "frontend": "frontend development", "backend": "backend development",
    "fullstack": "fullstack development", "devops": "devops", "cicd": "continuous integration",
    "docker": "containerization", "kubernetes": "container orchestration", "aws": "cloud computing",
    "azure": "cloud computing", "gcp": "cloud computing",
}

EXPANSIONS = {
    "ml": "machine learning", "ai": "artificial intelligence", "dl": "deep learning",
    "nlp": "natural language processing", "cv": "computer vision", "api": "application programming interface",
    "rest": "representational state transfer", "crud": "create read update delete", "orm": "object relational mapping",
    "sql": "structured query language", "nosql": "non relational database",
    "cicd": "continuous integration deployment", "devops": "development operations", "ui": "user interface",
    "ux": "user experience", "db": "database", "regex": "regular expression", "gpu": "graphics processing unit",
    "cpu": "central processing unit", "ram": "random access memory", "ssd": "solid state drive",
    "hdd": "hard disk drive",
}

#: Only the first three of each list are used, so only those are kept.
SYNONYMS = {
    "search": ["find", "lookup", "query"], "document": ["file", "doc", "paper"],
    "image": ["picture", "photo", "graphic"], "create": ["make", "build", "generate"],
    "delete": ["remove", "erase", "discard"], "update": ["modify", "change", "edit"],
    "optimize": ["improve", "enhance", "refine"], "analyze": ["examine", "study", "investigate"],
    "implement": ["build", "develop", "code"], "debug": ["fix", "troubleshoot", "resolve"],
    "deploy": ["release", "publish", "launch"], "test": ["verify", "validate", "check"],
    "design": ["plan", "architect", "structure"], "algorithm": ["method", "procedure", "approach"],
    "framework": ["library", "toolkit", "platform"], "tutorial": ["guide", "walkthrough", "lesson"],
    "example": ["sample", "demo", "illustration"], "error": ["bug", "issue", "problem"],
    "performance": ["speed", "efficiency", "optimization"], "security": ["safety", "protection", "authentication"],
    "learn": ["study", "understand", "master"], "explain": ["describe", "clarify", "elucidate"],
    "install": ["setup", "configure", "deploy"], "run": ["execute", "launch", "start"],
    "configure": ["setup", "set", "adjust"], "integrate": ["combine", "merge", "connect"],
}

URL = r"https?://[^\s]+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
NOT_PLAIN = r"[^a-z0-9\s'-]"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
NUMBER = r"\b(\d+)\b"

INTENTS = ("LOOKUP", "EXPLORATION", "FACT_FINDING", "CODE_SEARCH", "RECENT_FILES")
QUESTION_STARTS = ("what is", "how does", "how to", "why", "when", "where")

PARSEABLE = (
    "txt md csv json xml html htm kt py java c cpp h hpp js ts sh bat gradle properties yml yaml log conf ini pdf"
).split()
BOOSTED_TYPES, MUTED_TYPES = ("pdf", "txt", "md"), ("jpg", "png", "jpeg", "gif", "webp")
# ----------------------------------------------------------------------------
