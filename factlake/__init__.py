"""factlake: DataFrame operators over bitemporal financial facts."""
