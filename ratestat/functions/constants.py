"""Fixed values of the survey data model.

These must equal the original analysis for results to line up; they are
stated here plainly, in their natural order.
"""

# --- fixed values: column names of the three headerless survey files -------
NUMERIC_COLUMNS = [
    "Average Rating",
    "Average Difficulty",
    "Number of ratings",
    "Received a “pepper”?",
    "The proportion of students that said they would take the class again",
    "The number of ratings coming from online classes",
    "Male gender",
    "Female",
]

QUALITATIVE_COLUMNS = [
    "Major/Field",
    "University",
    "US State",
]

TAG_COLUMNS = [
    "Tough grader",
    "Good feedback",
    "Respected",
    "Lots to read",
    "Participation matters",
    "Don’t skip class or you will not pass",
    "Lots of homework",
    "Inspirational",
    "Pop quizzes!",
    "Accessible",
    "So many papers",
    "Clear grading",
    "Hilarious",
    "Test heavy",
    "Graded by few things",
    "Amazing lectures",
    "Caring",
    "Extra credit",
    "Group projects",
    "Lecture heavy",
]

# --- fixed values: derived column names ------------------------------------
RATING = "Average Rating"
DIFFICULTY = "Average Difficulty"
N_RATINGS = "Number of ratings"
PEPPER = "Received a “pepper”?"
AGAIN = "The proportion of students that said they would take the class again"
ONLINE = "The number of ratings coming from online classes"
MALE = "Male gender"
FEMALE = "Female"
STATE = "US State"
ADJUSTED_SUFFIX = " (Adjusted)"
NORMALIZED_SUFFIX = " (Normalized)"
TOTAL_TAGS = "Total Number of Tags"
TAGS_PER_RATING = "Average Tags per Rating"

# --- fixed values: tokens that pandas.read_csv reads as missing ------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: the 50 state codes kept on the map (no DC) --------------
US_STATE_CODES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL",
    "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT",
    "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI",
    "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]

# --- fixed values: analysis parameters -------------------------------------
ALPHA = 0.005
SEED = 1
BOOT_REPLICATES = 5000
BOOT_DRAWS = 10000
TAG_VALUE_CAP = 1.01
MIN_RATINGS_FOR_TAGS = 3
TEST_FRACTION = 0.2


def normalized(tag: str) -> str:
    return f"{tag}{NORMALIZED_SUFFIX}"


def adjusted(col: str) -> str:
    return f"{col}{ADJUSTED_SUFFIX}"


def adjusted_column_order(tags=TAG_COLUMNS):
    """The 55-column order of the adjusted table."""
    return [
        RATING, adjusted(RATING), DIFFICULTY, adjusted(DIFFICULTY), N_RATINGS,
        PEPPER, AGAIN, ONLINE, MALE, FEMALE,
        *QUALITATIVE_COLUMNS,
        *tags,
        *[normalized(t) for t in tags],
        TOTAL_TAGS, TAGS_PER_RATING,
    ]
