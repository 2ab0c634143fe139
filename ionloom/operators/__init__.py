"""DataFrame operators over spectra and ions."""
