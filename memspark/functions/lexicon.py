"""Phrase lists, word lists and markers of the default configuration.

Each function that uses one takes it as a parameter.
"""

from __future__ import annotations

# Phrases by which a person corrects an earlier answer.
CORRECTION_PHRASES = [
    "we already built", "already exists", "doesn't that exist",
    "you already wrote", "we have that", "that's already in",
    "no, look at", "check the existing", "see the existing",
    "we ruled out", "we abandoned", "didn't work last time",
    "we tried that", "you missed", "you didn't read",
    "no shortcuts", "stop doing", "don't do that",
    "wrong, the actual", "actually it's", "you're wrong about",
]
# Phrases that state a decision.
DECISION_PHRASES = [
    "the design is", "we decided", "this is why", "the fix is",
    "root cause", "the issue was", "going forward", "the approach",
    "already exists", "we already built", "was built", "is production",
    "is dormant", "was abandoned", "do not rebuild", "the finding",
    "the result", "the conclusion", "the architecture", "the spec",
]
# Phrases that start an investigation.
INVESTIGATION_PHRASES = [
    "let's investigate", "trace why", "diagnose", "let's look at",
    "what's going on with", "deeper trace", "investigate this",
]
# Markers of machine-made summaries.
COMPACTION_MARKERS = [
    "this session is being continued from a previous conversation",
    "the summary below covers the earlier portion of the conversation",
]
# Phrases that mark a subsystem not to be built again.
DO_NOT_REBUILD_PHRASES = [
    "do not rebuild", "do not re-build", "already built",
    "is production", "is dormant", "was built",
    "dormant", "built but never enabled", "never enabled in production",
]
# Phrases of a build, investigation or decision intent, and what disqualifies the first.
BUILD_INTENT = [
    "build", "create", "add ", "add a ", "add the ",
    "implement", "design", "architect",
    "develop", "write", "wire ", "refactor", "introduce", "propose",
    "spec ", "draft", "we could ",
    "what if we", "i think we need", "we need to add",
]
INVESTIGATION_INTENT = [
    "investigate", "trace why", "understand why", "diagnose", "explore",
    "look at the", "look into", "why does", "what causes", "find out",
    "figure out", "dig into", "deep dive",
]
DECISION_INTENT = [
    "should we", "should i", "double-down", "double down", "step back",
    "step-back", "do we pivot", "should we pivot", "or pivot",
    "or keep going", "or should we", "decision lineage", "design lineage",
    "which approach", "which direction", "double down or",
    "keep this approach", "revisit the decision", "revisiting the decision",
    "reconsider",
]
PAST_TENSE = [
    "was built", "were built", "already built",
    "already implemented", "was implemented",
    "already added", "was added",
    "already created", "was created",
]
# Fixed values: (marker, reason, kind) of text that a harness put into a conversation, in order.
HARNESS_MARKERS = [
    ("Base directory for this skill:", "skill_file_body", "prefix"),
    ("<task-notification>", "task_notification", "tag"),
    ("<system-reminder>", "system_reminder", "tag"),
    ("<command-name>", "command_name", "tag"),
    ("<local-command-", "local_command", "tag"),
    ("<ide_selection>", "ide_selection", "tag"),
    ("UserPromptSubmit hook success", "hook_stdout", "prefix"),
    ("UserPromptSubmit hook", "hook_stdout", "prefix"),
    ("SessionStart hook", "hook_stdout", "prefix"),
    ("hook success", "hook_stdout", "prefix"),
    ("This session is being continued from a previous conversation", "compaction_summary", "prefix"),
]
# Openers of turns that no person wrote.
SYSTEM_TURN_OPENERS = ["<task-notification>", "<local-command-stdout>", "<local-command-caveat>", "<command-name>", "<system-reminder>"]
# Words that carry no topic, and short words that do.
STOPWORDS = [
    "should", "would", "could", "this", "that", "with", "from", "have",
    "about", "into", "what", "when", "where", "which", "your", "ours",
    "keep", "going", "change", "look", "want", "need", "make", "does",
    "the", "and", "for", "are", "but", "not", "you", "our", "out", "now",
]
ALLOWED_SHORT = ["gw", "mlm", "f8", "pe", "sp", "c2", "c3", "ddx", "slm", "hss", "mlp"]
# Cues of decisions (add "<name> approved" for each approver) and of dead ends in a sentence.
DECISION_CUES = [
    "we decided", "decision:", "locked in", "we lock in",
    "let's go with", "we'll go with", "going with the",
    "we're going with", "route =", "we choose", "we chose", "approved:",
    "we will go with", "we are going with",
]
DEAD_END_CUES = [
    "rejected", "shelved", "deferred", "superseded", "not pursue",
    "won't pursue", "abandoned", "wrong paradigm", "dead end", "dead-end",
    "ruled out", "scrapped", "backed out", "we are explicitly not",
]
MAINTENANCE_PREFIXES = ["MEMORY.md", "Compacting the", "Trimming"]
# Whole titles that merely acknowledge (case-insensitive).
STATUS_ECHO = [
    r"locked in", r"all .{0,20} locked in", r"everything.{0,20}locked in",
    r"(?:it's|its|that's|thats|this is|we're|were) .{0,20}locked in",
    r"all .{0,20}(?:approved|confirmed|good|set|done|green)",
    r"(?:approved|confirmed|agreed|done|understood|perfect|sounds good|all set|ship it|got it)",
]
# Acronyms with their long forms and, where case matters, surface forms.
ACRONYMS = [
    ("cwm", ["causal world model"], []),
    ("ddx", ["differential diagnosis"], []),
    ("mlm", ["motivated language model"], []),
    ("slm", ["small language model"], []),
    ("r-slm", ["right small language model", "right-hemisphere small language model"], []),
    ("hss", ["hidden state server"], []),
    ("gw", ["global workspace"], ["GW"]),
    ("kmi", ["knowledge-mode interoception"], []),
    ("rsi", ["recursive self-improvement"], []),
    ("acc", ["anterior cingulate cortex"], ["ACC"]),
    ("lsh", ["locality-sensitive hashing"], []),
    ("ema", ["exponential moving average"], []),
    ("jepa", ["joint embedding predictive architecture"], []),
    ("tom", ["theory of mind"], ["ToM"]),
    ("fm", ["forward model"], ["FM"]),
    ("gnn", ["graph neural network"], []),
]
# Patterns of symbols that name a topic, most specific first, and words that never do.
TOPIC_PATTERNS = [
    r"\b([a-z_][a-z0-9_]*_(?:kernel|loop|gate|engine|module|flag|head|hook|client|writer|reader|store))\b",
    r"\b(use_[a-z_][a-z0-9_]*)\b",
    r"\b([a-z_]+_[a-z_]+_[a-z_]+)\b",
]
TOPIC_STOPWORDS = [
    "already", "exists", "built", "build", "design", "implement", "create",
    "loop", "gate", "module", "kernel", "engine", "let's", "we've",
    "lets", "have", "that", "this", "with", "from", "into", "what",
    "when", "where", "which", "while", "would", "could", "should",
    "about", "after", "again", "their", "there", "these", "those",
    "thing", "things", "doing", "going", "looking", "saying",
    "check", "look", "see", "stop", "wrong", "right", "okay",
    "actually", "really", "just",
]
# Patterns of cited symbols; sources (add that of recorded sessions) and paths of narrative records.
SYMBOL_PATTERNS = [
    r"\b((?:src|scripts|tests|tools)/[a-zA-Z0-9_/\.\-]+)\b",
    r"\b(use_[a-z_][a-z0-9_]*)\b",
    r"\b([a-z_][a-z0-9_]*(?:_[a-z0-9_]+){2,})\b",
]
NARRATIVE_SOURCES = ["memory", "checkpoint"]
NARRATIVE_PATHS = ["docs/marathon", "memory/checkpoint", "MEMORY.md"]
# File names of canonical documents and prefixes of curated corrections.
CANONICAL_DOCS = ["substrate_capability_inventory.md"]
CURATED_PREFIXES = ["feedback_", "invariant_"]
# Folders whose files are never ingested.
SKIPPED_FOLDERS = [".git", "node_modules", "__pycache__", ".venv", "venv"]
NUDGE_TOOLS = ["Edit", "Write", "Bash", "Agent", "NotebookEdit"]
# Text fields of each tool's payload, in order.
TOOL_FIELDS = {
    "Edit": ["file_path", "old_string", "new_string"],
    "Write": ["file_path", "content"],
    "Bash": ["description", "command"],
    "Agent": ["subagent_type", "description", "prompt"],
    "NotebookEdit": ["notebook_path", "new_source"],
}
# What is read of finished tools besides the response, in order.
POST_TOOL_FIELDS = {**TOOL_FIELDS, "Grep": ["pattern", "path"]}
