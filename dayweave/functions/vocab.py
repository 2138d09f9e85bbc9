"""Word lists, scales and coefficients the results depend on."""

# Diary rating words, in matching order.
RATING_WORDS = {
    "great": ["awesome", "great"],
    "good": ["good day", "good"],
    "pretty good": ["pretty good", "reasonably good"],
    "ok": ["average", "ok", "ok day"],
    "ups and downs": [
        "up and down",
        "pain was ok when day was warm. but once it got cold, pain ratcheted up",
    ],
    "not great": ["not great", "blah", "not a great"],
}

# Diary activity words.
ACTIVITY_WORDS = {
    "rest": ["rest", "resting", "nap", "quiet", "relaxed"],
    "excercise": ["yoga", "bike", "too much walking"],
    "medical_appointment": [
        "counseling",
        "saw dr",
        "doctor",
        "medical appointment",
        "acupuncture",
        "accupunture",
        "therapy",
        "platelets",
        "blood test",
    ],
    "selfcare": ["massage", "self care"],
    "household": ["laundry", "cleaning", "garden"],
    "social": [
        "with a friend",
        "movie day",
        "friends",
        "social",
        "had some company",
        "family",
        "saw a play",
        "board game",
    ],
}

# Ordinal code of a rating.
RATING_ORDINAL = {
    "not great": 0,
    "ups and downs": 1,
    "ok": 2,
    "pretty good": 3,
    "good": 4,
    "great": 5,
}

# The two mood scales.
MOOD_1_TO_8 = {
    "Really Good": 8,
    "Good": 7,
    "Fine": 6,
    "Variable but mostly good": 5,
    "Ok, but also not really that great": 4,
    "Variable but mostly not great": 3,
    "Tired": 2,
    "Depressed": 1,
}
MOOD_3_TO_9 = {
    "Really Good": 9.0,
    "Good": 8.0,
    "Fine": 7.0,
    "Ok, but also not really that great": 6.0,
    "Tired": 5.0,
    "Not Great": 4.0,
    "Depressed": 3.0,
}
MOOD_DEFAULT = 5.5

# Effort words.
EFFORT_LEVELS = {
    "Very Low": 1,
    "Low": 2,
    "Medium Low": 3,
    "Medium": 4,
    "High": 5,
    "Very High": 6,
}

# Low-body and high-body share of the heart load by activity class.
HEART_SHARES = {
    "walking": (1.0, 0.0),
    "cycling": (1.0, 0.1),
    "swimming": (0.1, 0.9),
    "rock_climbing": (0.25, 0.75),
    "25/75": (0.25, 0.75),
    "homeExercises": (0.1, 0.9),
    "50/50": (0.5, 0.5),
    "backcountry skiing": (0.75, 0.25),
    "Resort skiing": (0.95, 0.05),
}

# Activity names of the two feeds to activity class.
DEVICE_ACTIVITY_CLASS = {
    "walking": "walking",
    "cycling": "cycling",
    "swimming": "swimming",
    "surfing": "swimming",
    "rock_climbing": "rock_climbing",
    "generic": "rock_climbing",
    "training": "homeExercises",
    "fitness_equipment": "homeExercises",
    "Cliff jumping": "50/50",
    "Cliff jumping ": "50/50",
    "Gardening": "50/50",
    "Handyman work": "homeExercises",
    "House Cleaning": "50/50",
    "House cleaning": "50/50",
    "Other": "rock_climbing",
    "Sawing": "homeExercises",
    "Trail building": "50/50",
    "trail building": "50/50",
    "backcountry skiing": "backcountry skiing",
    "moving snow": "25/75",
    "Moving snow": "25/75",
    "Resort skiing": "Resort skiing",
    "Trottinette": "cycling",
    "Trottinette ": "cycling",
}
EXPORT_ACTIVITY_CLASS = {
    "cycling": "cycling",
    "lap_swimming": "swimming",
    "mountaineering": "rock_climbing",
    "open_water_swimming": "swimming",
    "other": "rock_climbing",
    "rock_climbing": "rock_climbing",
    "strength_training": "homeExercises",
    "surfing_v2": "swimming",
    "walking": "walking",
}

# Sports with their own calorie bucket, climbing-like sports and
# the name parts that move a climbing-like activity elsewhere.
DIRECT_SPORTS = {"cycling": "cycling", "swimming": "swimming"}
CLIMBING_SPORTS = ["other", "rock_climbing", "bouldering", "climbing", "generic"]
NAMED_ACTIVITIES = {"cliff jumping": "cliff", "backcountry skiing": "ski"}

# Tap-log labels merged before matching.
TAP_RECODE = {"Alpi Ski": "Ski", "Down Ski": "Ski", "Mt Bike": "Cycling"}

# Pain intensity to effect score: below a limit, at one value, up to a limit, and beyond.
PAIN_BELOW = [(2.5, 1.0), (3.0, 2.0), (3.3, 4.0)]
PAIN_AT, PAIN_UP_TO, PAIN_BEYOND = (3.3, 7.0), (3.5, 8.0), 10.0

# Steps per minute on a scooter, joules per calorie as exported, basal calories per day, calories per minute of jumping.
SCOOTER_STEPS, CALORIE_UNIT, BASAL_PER_DAY, JUMP_PER_MINUTE = 37.0, 4.19002, 2039.0, 3.3

# Share of an activity's calories that goes to the knees (after the total) and to the arms.
KNEE_SHARES = {"swim": -1.0, "climb": -0.75, "cliff": 0.5, "ski": -0.25}
ARM_SHARES = {"swim": 1.0, "climb": 0.75, "cycle": 0.1, "cliff": 0.5, "ski": 0.25}
