"""Rule tables and output texts.

FIXED VALUES: everything in this module must equal the original application's
tables and wording for results to match. They are kept as plain data, in their
original order; the operators turn them into small DataFrames or column
expressions at run time.
"""

from __future__ import annotations

# ---- fixed values: genre handling --------------------------------------------
NO_GENRE = "(no genres listed)"

# ---- fixed values: theme tags (genres needed, tag), ordered ---------------------
THEME_TAGS: list[tuple[tuple[str, ...], str]] = [
    (("Mystery", "Thriller", "Crime"), "espionage & betrayal plots"),
    (("Action", "Adventure"), "high-stakes action set pieces"),
    (("Drama",), "morally complex characters"),
    (("Mystery", "Thriller"), "slow pacing & tension"),
    (("Sci-Fi",), "speculative ideas & future worlds"),
    (("Horror",), "dread & atmosphere"),
    (("Romance", "Comedy"), "warmth & human connection"),
    (("War",), "conflict & sacrifice"),
]
DEFAULT_THEME = "variety across story and tone"

# ---- fixed values: franchise title patterns, franchise order then pattern order --
FRANCHISE_PATTERNS: list[tuple[str, list[str]]] = [
    ("James Bond", [
        "dr. no", "from russia with love", "goldfinger", "thunderball", "you only live twice",
        "on her majesty", "diamonds are forever", "live and let die", "man with the golden gun",
        "spy who loved me", "moonraker", "for your eyes only", "octopussy", "view to a kill",
        "living daylights", "licence to kill", "license to kill", "goldeneye",
        "tomorrow never dies", "world is not enough", "die another day", "casino royale",
        "quantum of solace", "skyfall", "spectre", "no time to die",
    ]),
    ("Lord of the Rings", ["lord of the rings", "hobbit"]),
    ("Harry Potter", ["harry potter"]),
    ("Star Wars", ["star wars"]),
    ("Mission: Impossible", ["mission: impossible", "mission impossible"]),
    ("Marvel", ["avengers", "iron man", "thor", "captain america", "guardians of the galaxy"]),
]

# ---- fixed values: style rules (genres needed, label), ordered --------------------
STYLE_RULES: list[tuple[tuple[str, ...], str]] = [
    (("Mystery", "Thriller", "Crime"), "slow-burn + plot-heavy"),
    (("Action", "Adventure"), "fast-paced + spectacle-driven"),
    (("Drama", "Romance"), "character-driven + emotional"),
    (("Sci-Fi", "Fantasy"), "world-building + imaginative"),
    (("Horror", "Thriller"), "suspense + atmosphere"),
    (("Comedy",), "lighthearted + witty"),
]
DEFAULT_STYLE = "balanced + genre-mixing"

# ---- fixed values: personas (title, emoji, genres, min overlap, blurb), ordered --
PERSONA_RULES: list[tuple[str, str, tuple[str, ...], int, str]] = [
    ("The High-Stakes Adrenaline Junkie", "\U0001F4A5", ("Action", "Adventure", "Thriller"), 2,
     "You crave massive set pieces, international stakes, and heroes who save the day "
     "when the clock hits zero. Relaxing is optional — adrenaline is not."),
    ("The Covert Operative", "\U0001F575️", ("Mystery", "Thriller", "Crime"), 2,
     "You love intelligence games, slow-burn tension, and plots where trust is the "
     "real weapon. Every conversation might be a trap."),
    ("The Future Architect", "\U0001F680", ("Sci-Fi", "Fantasy", "Adventure"), 2,
     "You build worlds in your head — futuristic tech, mythic quests, and ideas bigger "
     "than the screen. Reality is just the default setting."),
    ("The Character Study Enthusiast", "\U0001F3AD", ("Drama", "Romance", "War"), 2,
     "You watch for human depth — moral gray zones, relationships under pressure, "
     "and performances that linger after the credits."),
    ("The Midnight Thrill Seeker", "\U0001F47B", ("Horror", "Thriller", "Mystery"), 2,
     "You want atmosphere, dread, and stories that keep you checking the locks on "
     "your doors. Comfort is overrated."),
    ("The Feel-Good Curator", "\U0001F604", ("Comedy", "Romance", "Family"), 2,
     "You pick films that lift the mood — warmth, laughs, and endings that leave "
     "you smiling. Life is heavy enough already."),
    ("The Epic Questor", "⚔️", ("Fantasy", "Adventure", "Action"), 2,
     "You follow heroes on impossible journeys — kingdoms, battles, and destinies "
     "written in prophecy and steel."),
]
DEFAULT_PERSONA = (
    "The Eclectic Cinephile", "\U0001F3AC",
    "Your picks span genres and eras — you refuse one lane and chase variety, "
    "from blockbusters to hidden gems.",
)

# ---- fixed values: scoring constants -------------------------------------------
CONTENT_WEIGHT = 0.6
COLLAB_WEIGHT = 0.4
DISLIKE_PENALTY = 0.55
LIKE_BOOST = 0.18
FEEDBACK_SIMILARITY_WEIGHT = 0.15
DIVERSITY_DEFAULT = 0.35
DIVERSITY_PENALTY_SCALE = 0.35
EXPLAIN_THRESHOLD = 0.40
MATCH_BANDS = [(0.85, "Very strong fit"), (0.70, "Good fit"), (0.50, "Moderate fit")]
MATCH_BAND_DEFAULT = "Weaker fit"
POSTER_BASE = "https://image.tmdb.org/t/p/w500"
TOP_CAST = 5
MIN_COHORT_RATING = 4.0
COHORT_TOP = 200

# ---- fixed values: output texts (format placeholders in braces) ---------------------
TXT_HEADLINE_LIKED = "Because you liked **{seed}**"
TXT_HEADLINE_THEME = "this shares **{theme}**"
TXT_HEADLINE_DNA = "this shares **{shared}** DNA"
TXT_HEADLINE_FALLBACK = "this fits your taste fingerprint"
TXT_BULLET_OVERLAP = "Genre overlap with *{seed}*: {shared}"
TXT_BULLET_ERA = "Same era ({decade}) as several of your favorites"
TXT_BULLET_CONTENT = "Content match {pct}% — similar genres, era, and metadata profile"
TXT_BULLET_COLLAB = "HybridNet taste match {pct}% — users with your picks tend to rate this highly"
TXT_BULLET_FALLBACK = "Recommended based on fit with {titles}"
TXT_COHORT_NOTE = "Highly rated by MovieLens users who also liked {anchor} ({count} high ratings)"
TXT_FRANCHISE_REASON = "More in the {franchise} series"
TXT_HYBRID_REASON = "Similar to your picks (HybridNet)"
TXT_STORYTELLING = " storytelling"
TXT_PEAK = " (peak)"
TXT_MIXED_ERAS = "Mixed eras"
TXT_SUMMARY = (
    "As **{emoji} {title}**, you lean toward {pct_line}. "
    "Your style reads as **{style}**, especially from the {decades}, "
    "with {genres} showing up most often."
)
TXT_STRONG_STREAK = ", with a strong {genre} streak ({pct}%)"
TXT_VARIED_GENRES = "varied genres"
TXT_MANY_ERAS = "many eras"
TXT_YOUR_PICKS = "your picks"
TXT_MIXED_PRIMARY = "Mixed"
