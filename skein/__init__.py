"""skein: a clause-language, multi-model analytics engine expressed as Spark DataFrame plans."""
