"""DataFrame-to-DataFrame operators on ticks, bars, panels, labels and ledgers."""
