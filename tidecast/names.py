"""Fixed column names of draws and predictions."""

CHAIN_DIM, DRAW_DIM = "chain", "draw"
SAMPLE_DIMS = (CHAIN_DIM, DRAW_DIM)
TIME_DIM, FUTURE_DIM = "time", "time_future"
OBS_VAR, FORECAST_VAR = "obs", "forecast"
MU_VAR, MU_FORECAST_VAR = "mu", "mu_future"
PREDICTIVE_GROUPS = ("predictions", "posterior_predictive")
POS = "pos"
