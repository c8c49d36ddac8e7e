"""Fixed word lists and patterns; operators take them as replaceable defaults."""

# Technical-debt keywords, form A.
DEBT_KEYWORDS_A = [
    "refactor", "cleanup", "legacy", "technical debt", "debt", "deprecated", "old", "outdated", "improve",
    "optimization", "performance", "maintainability",
]

# Technical-debt terms, form B, and the issue types whose labels count.
DEBT_TERMS_B = [
    "refactor", "cleanup", "technical debt", "tech debt", "legacy", "deprecated", "outdated", "performance",
    "optimization", "maintenance", "improvement",
]
IMPROVEMENT_TYPES = ["improvement", "enhancement", "task"]

# Debt priority, form A.
PRIORITY_A = {
    "high": ["critical", "urgent", "security", "outage", "performance"],
    "medium": ["improvement", "optimization", "maintainability"],
}

# Debt priority, form B.
PRIORITY_B = {
    "high": [
        "critical", "urgent", "security", "vulnerability", "outage", "failure", "bug", "crash", "error", "broken",
        "blocking",
    ],
    "medium": ["performance", "slow", "optimization", "deprecated", "legacy", "debt", "refactor", "improvement"],
    "low": ["cleanup", "style", "formatting", "documentation", "typo", "minor", "enhancement"],
    "labels": ["critical", "urgent", "security", "blocking"],
}

# Effort indicators, form A.
EFFORT_A = {
    "complex": [
        "complete", "entire", "full", "comprehensive", "major", "significant", "multiple", "everything",
        "throughout", "across",
    ],
    "simple": ["simple", "minor", "small", "quick", "easy", "basic", "single", "fix", "typo"],
    "medium": ["refactor", "update", "all", "module", "library"],
}

# Effort indicators, form B.
EFFORT_B = {
    "complex": [
        "architecture", "system", "migration", "overhaul", "complete", "entire", "multiple", "integration",
        "infrastructure", "platform", "security audit", "performance optimization", "api", "database",
    ],
    "simple": [
        "typo", "style", "formatting", "minor", "small", "quick", "simple", "fix", "update", "documentation",
    ],
}

# Seed phrases of the debt search and the fixed texts of two search tools.
DEBT_SEEDS = [
    "technical debt", "tech debt", "refactor", "refactoring", "code cleanup", "optimization", "performance", "legacy",
    "deprecated", "outdated", "debt", "cleanup", "improve", "enhancement", "maintenance",
]
DEBT_SEARCH_TEXT = "technical debt refactoring cleanup code quality maintenance"
DEPENDENCY_SEARCH_TEXT = "blocked depends dependency waiting blocker"

# Abbreviations that do not end a sentence.
ABBREVIATIONS = [
    "Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "vs", "etc", "Inc", "Ltd", "Co", "Corp", "St", "Ave", "Rd", "Blvd",
]

# Query-text patterns (case-insensitive, Unicode word boundaries).
ITEM_TYPES = {
    "Story": r"\b(story|stories|user story)\b",
    "Task": r"\b(task|tasks)\b",
    "Bug": r"\b(bug|bugs|defect|defects|issue)\b",
    "Epic": r"\b(epic|epics)\b",
}
STATUSES = {
    "Open": r"\b(open|new|created)\b",
    "In Progress": r"\b(in progress|active|working|started)\b",
    "Done": r"\b(done|completed|finished|closed|resolved)\b",
    "Blocked": r"\b(blocked|waiting|on hold)\b",
}
PRIORITIES = {
    "High": r"\b(high|urgent|critical|important)\b",
    "Medium": r"\b(medium|normal|standard)\b",
    "Low": r"\b(low|minor|trivial)\b",
}
COMPONENTS = {
    "frontend": r"\b(frontend|front-end|ui)\b",
    "backend": r"\b(backend|back-end|api)\b",
    "mobile": r"\b(mobile|ios|android)\b",
    "platform": r"\b(platform|infrastructure)\b",
}
TEAMS = {
    "Platform": r"\b(platform team|platform)\b",
    "Frontend": r"\b(frontend team|frontend)\b",
    "Backend": r"\b(backend team|backend)\b",
    "Mobile": r"\b(mobile team|mobile)\b",
}
# Days covered by a time phrase; the first one found counts.
TIME_PHRASES = {
    "last week": 7, "last month": 30, "last quarter": 90, "this week": 7, "this month": 30, "this quarter": 90,
    "yesterday": 1, "today": 0, "recent": 14, "last sprint": 14, "current sprint": 14,
}
ANALYSIS_WORDS = ["analyze", "analysis", "report", "summary", "trends", "patterns"]
SUMMARY_WORDS = ["summary", "report", "analysis"]
URGENT_WORDS = ["urgent", "critical", "important"]
SYNONYMS = {
    "story": ["user story", "feature", "requirement"],
    "bug": ["defect", "issue", "problem", "error"],
    "task": ["work item", "todo", "action item"],
    "epic": ["initiative", "theme", "project"],
    "blocked": ["waiting", "on hold", "dependency"],
    "done": ["completed", "finished", "resolved", "closed"],
    "in progress": ["active", "working", "started", "wip"],
    "high priority": ["urgent", "critical", "important"],
    "technical debt": ["refactoring", "cleanup", "maintenance"],
}
# Concept groups (trigger words, variants).
VARIANTS = [
    (["debt", "refactor", "cleanup"], ["technical debt", "refactoring", "code quality", "maintenance"]),
    (["slow", "performance", "speed"], ["performance", "optimization", "latency", "speed"]),
    (["bug", "error", "issue"], ["defect", "problem", "failure", "broken"]),
]
