"""Default value lists of the scenario filters: an empty choice stands for these."""

# Fixed values.
MAP_CONTINENTS = ["Europe", "North America", "South America", "Asia", "Africa", "Oceania"]

AGE_FILTERS = {
    "sport": ["Alpine Skiing", "Biathlon", "Ice Hockey", "Boxing", "Gymnastics", "Tennis"],
    "sex": ["Male", "Female"],
}

AGE_PATH = ["year", "sport", "medal"]

BODY_FILTERS = {
    "sport": ["Athletics", "Canoeing", "Fencing", "Gymnastics", "Rowing"],
    "age_bin": ["1-20", "21-25", "26-30", "31-40"],
    "bmi_bin": [
        "18.51-20.56", "20.57-22.61", "22.62-24.66", "24.67-26.7", "26.71-28.75", "28.76-30.8", "30.81-32.85",
    ],
}

DOUBLE_FILTERS = {
    "season": ["Summer", "Winter"],
    "years_to_two": ["S.Y.", "2", "4", "8"],
    "noc": [
        "POL", "FRA", "ITA", "UKR", "GBR", "TCH", "SVK", "HUN", "NOR", "FIN", "DEN", "NED", "AUT", "LIE", "GER", "YUG",
        "SUI", "ROU", "CRO", "ESP", "SWE", "BUL", "BEL", "GRE", "LAT", "CZE", "FRG", "GDR",
    ],
}

FLOW_FILTERS = {
    "sex": ["Male", "Female"],
    "gold_count": ["2", "3", "4", "5", "6"],
}
