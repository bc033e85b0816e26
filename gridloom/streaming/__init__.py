"""Nothing streams: every operator here is a batch plan over whole tables, and none needs state, watermarks or triggers."""
