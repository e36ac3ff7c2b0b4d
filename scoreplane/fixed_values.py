"""Fixed values.

Values that must equal the original application's for right results:
label set, similarity lookup tables, classifier weights and boost terms,
scalar thresholds, patterns and service constants. They are stated here
plainly, in their natural order, and are turned into small rule tables by
``scoreplane.rules``. Keyword and phrase-replacement lists are NOT fixed
values: they are input tables supplied by the caller.
"""

# ---- FIXED VALUES: valid domain labels (case-sensitive membership) ----
DOMAIN_LABELS = [
    "Data Science", "AI/Machine Learning", "UI/UX Design", "Mobile Development",
    "Frontend Development", "Backend Development", "Full Stack Development", "Cybersecurity",
    "Cloud Engineering", "DevOps/Infrastructure", "Quality Assurance", "Game Development",
    "Blockchain Development", "Embedded Systems", "System Architecture", "Database Management",
    "Networking", "Site Reliability Engineering", "Product Management", "Project Management",
    "Business Analysis", "Technical Writing", "Digital Marketing", "E-commerce", "Fintech",
    "Healthcare Tech", "EdTech", "IoT Development", "AR/VR Development", "Technical Sales",
    "Agile Coaching", "Software Engineering", "Unclassified",
]
UNCLASSIFIED = "Unclassified"

# ---- FIXED VALUES: classifier weights per domain (rule order = tie order) ----
DOMAIN_WEIGHTS = {
    "Data Science": 4, "AI/Machine Learning": 4, "UI/UX Design": 3,
    "Mobile Development": 3, "Frontend Development": 3, "Backend Development": 3,
    "Full Stack Development": 4, "Cybersecurity": 4, "Cloud Engineering": 3,
    "DevOps/Infrastructure": 3, "Quality Assurance": 3, "Game Development": 3,
    "Blockchain Development": 3, "Embedded Systems": 3, "System Architecture": 4,
    "Database Management": 3, "Networking": 3, "Site Reliability Engineering": 3,
    "Product Management": 3, "Project Management": 3, "Business Analysis": 3,
    "Technical Writing": 2, "Digital Marketing": 3, "E-commerce": 3, "Fintech": 3,
    "Healthcare Tech": 3, "EdTech": 3, "IoT Development": 3, "AR/VR Development": 3,
    "Technical Sales": 2, "Agile Coaching": 2, "Software Engineering": 2,
}

# ---- FIXED VALUES: boost terms (+8 when in title, +3 when in description) ----
DOMAIN_BOOSTS = {
    "AI/Machine Learning": ["ai", "ml", "machine learning", "artificial intelligence"],
    "Cybersecurity": ["security", "cyber", "infosec"],
    "Cloud Engineering": ["cloud", "aws", "azure", "gcp"],
    "Mobile Development": ["mobile", "android", "ios", "app"],
    "Game Development": ["game", "unity", "unreal"],
    "Blockchain Development": ["blockchain", "crypto", "web3", "defi"],
    "IoT Development": ["iot", "embedded", "sensor"],
    "AR/VR Development": ["ar", "vr", "augmented", "virtual reality"],
}
BOOST_TITLE = 8
BOOST_DESC = 3

# ---- FIXED VALUES: classifier scalars ----
TITLE_FACTOR = 4
DESC_FACTOR = 1
MIN_SCORE = 8
SHORT_DESC_WORDS = 8
SHORT_DESC_PENALTY = 0.5
FULLSTACK_DOMAIN = "Full Stack Development"
FULLSTACK_TERMS = ["full stack", "fullstack", "full-stack"]
FULLSTACK_BONUS = 15
COMBO_DOMAINS = ("Frontend Development", "Backend Development")
COMBO_MIN_HITS = 4
COMBO_BONUS = 12
STRONG_PHRASES = ["full stack developer", "mobile developer", "android developer", "ios developer"]
# title overrides, checked in this order after the threshold test
TITLE_OVERRIDES = [
    ("full stack developer", "Full Stack Development"),
    ("mobile developer", "Mobile Development"),
    ("android developer", "Mobile Development"),
    ("ios developer", "Mobile Development"),
]

# ---- FIXED VALUES: similarity alias map (one hop) ----
SIMILARITY_ALIASES = {
    "frontend": "frontend development", "backend": "backend development",
    "fullstack": "full stack development", "full-stack": "full stack development",
    "ui/ux": "ui/ux design", "ux/ui": "ui/ux design",
    "software developer": "software engineering",
    "mobile developer": "mobile development",
    "android developer": "mobile development",
    "ios developer": "mobile development",
    "ai": "ai/machine learning", "machine learning": "ai/machine learning",
    "ml": "ai/machine learning", "artificial intelligence": "ai/machine learning",
    "cloud": "cloud engineering", "cloud engineer": "cloud engineering",
    "devops": "devops/infrastructure", "devops engineer": "devops/infrastructure",
    "cyber security": "cybersecurity", "cybersecurity engineer": "cybersecurity",
    "security analyst": "cybersecurity", "qa": "quality assurance",
    "test engineer": "quality assurance", "sre": "site reliability engineering",
    "dba": "database management", "database administrator": "database management",
    "product manager": "product management", "project manager": "project management",
    "business analyst": "business analysis", "technical writer": "technical writing",
    "game developer": "game development", "blockchain developer": "blockchain development",
}

# ---- FIXED VALUES: directed similarity pairs (forward key looked up first) ----
SIMILARITY_PAIRS = {
    ("full stack development", "frontend development"): 0.85,
    ("full stack development", "backend development"): 0.85,
    ("full stack development", "ui/ux design"): 0.70,
    ("full stack development", "mobile development"): 0.65,
    ("full stack development", "software engineering"): 0.80,
    ("frontend development", "ui/ux design"): 0.90,
    ("frontend development", "mobile development"): 0.70,
    ("frontend development", "software engineering"): 0.75,
    ("frontend development", "backend development"): 0.60,
    ("backend development", "database management"): 0.80,
    ("backend development", "cloud engineering"): 0.75,
    ("backend development", "devops/infrastructure"): 0.70,
    ("backend development", "system architecture"): 0.85,
    ("backend development", "software engineering"): 0.80,
    ("data science", "ai/machine learning"): 0.95,
    ("data science", "business analysis"): 0.70,
    ("ai/machine learning", "data science"): 0.95,
    ("ai/machine learning", "software engineering"): 0.65,
    ("cloud engineering", "devops/infrastructure"): 0.90,
    ("cloud engineering", "system architecture"): 0.80,
    ("cloud engineering", "site reliability engineering"): 0.85,
    ("devops/infrastructure", "site reliability engineering"): 0.90,
    ("devops/infrastructure", "system architecture"): 0.75,
    ("cybersecurity", "devops/infrastructure"): 0.70,
    ("cybersecurity", "cloud engineering"): 0.75,
    ("cybersecurity", "networking"): 0.80,
    ("cybersecurity", "system architecture"): 0.65,
    ("mobile development", "ui/ux design"): 0.75,
    ("mobile development", "software engineering"): 0.70,
    ("mobile development", "game development"): 0.60,
    ("quality assurance", "software engineering"): 0.75,
    ("quality assurance", "devops/infrastructure"): 0.65,
    ("quality assurance", "system architecture"): 0.60,
    ("product management", "business analysis"): 0.80,
    ("product management", "project management"): 0.75,
    ("project management", "agile coaching"): 0.85,
    ("business analysis", "data science"): 0.65,
    ("game development", "software engineering"): 0.70,
    ("blockchain development", "software engineering"): 0.70,
    ("blockchain development", "cybersecurity"): 0.65,
    ("embedded systems", "iot development"): 0.90,
    ("ar/vr development", "game development"): 0.80,
    ("ar/vr development", "mobile development"): 0.70,
    ("database management", "data science"): 0.75,
    ("database management", "system architecture"): 0.70,
    ("database management", "backend development"): 0.80,
    ("system architecture", "software engineering"): 0.85,
    ("system architecture", "cloud engineering"): 0.80,
    ("system architecture", "backend development"): 0.85,
    ("networking", "cybersecurity"): 0.80,
    ("networking", "devops/infrastructure"): 0.75,
    ("networking", "system architecture"): 0.70,
    ("fintech", "software engineering"): 0.70,
    ("fintech", "backend development"): 0.75,
    ("fintech", "cybersecurity"): 0.70,
    ("healthcare tech", "software engineering"): 0.70,
    ("edtech", "software engineering"): 0.70,
    ("e-commerce", "full stack development"): 0.80,
    ("e-commerce", "backend development"): 0.75,
    ("technical sales", "product management"): 0.65,
    ("technical writing", "business analysis"): 0.60,
    ("digital marketing", "business analysis"): 0.55,
    ("software engineering", "full stack development"): 0.80,
    ("software engineering", "frontend development"): 0.75,
    ("software engineering", "backend development"): 0.80,
    ("software engineering", "mobile development"): 0.70,
    ("software engineering", "game development"): 0.70,
    ("software engineering", "quality assurance"): 0.75,
}

# ---- FIXED VALUES: similarity groups and fallback scores ----
SIMILARITY_GROUPS = {
    "tech": ["software engineering", "full stack development", "frontend development",
             "backend development", "mobile development", "game development",
             "blockchain development", "embedded systems", "iot development"],
    "data": ["data science", "ai/machine learning", "business analysis"],
    "infrastructure": ["cloud engineering", "devops/infrastructure", "site reliability engineering",
                       "system architecture", "database management", "networking", "cybersecurity"],
    "management": ["product management", "project management", "business analysis", "agile coaching"],
    "design": ["ui/ux design", "ar/vr development"],
}
SAME_LABEL_SCORE = 1.0
SAME_GROUP_SCORE = 0.50
# unordered group pairs with their score; first matching rule wins
CROSS_GROUP_SCORES = [("tech", "infrastructure", 0.45), ("data", "tech", 0.40)]
DEFAULT_SIMILARITY = 0.25

# ---- FIXED VALUES: model-call bookkeeping constants ----
CACHE_TTL_HOURS = 24
ERROR_COOLDOWN_MINUTES = 5
QUOTA_COOLDOWN_MINUTES = 60
DAILY_KEY_LIMIT = 800
FAILURE_RETENTION_DAYS = 3
QUOTA_WORDS = ["quota", "rate limit", "429"]
REASON_QUOTA = "quota"
REASON_ERROR = "error"

# ---- FIXED VALUES: accounts, audit log and codes ----
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
LOCAL_ZONE = "Asia/Kolkata"
CODE_TTL_SECONDS = 180
LOGIN_ACTION = "login"

# ---- FIXED VALUES: analytics defaults ----
TOP_DOMAINS_DEFAULT = 5
DAY_HISTORY = 365
DAILY_STATS_DAYS = 90
BIAS_THRESHOLD = 0.6
RETENTION_DAYS = 365
